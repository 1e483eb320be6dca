"""Inverted index, corpus statistics and ranking models.

The index is a table of postings (term, doc_id, tf, length).  Scoring joins query terms with
postings and sums; documents without a query term are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import materialize


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, doc_id, tf, len."""
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    rows = words.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def corpus_statistics(posts: DataFrame) -> DataFrame:
    """term, df, cf."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def merge_statistics(*parts: DataFrame) -> DataFrame:
    """Statistics of disjoint collections add up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def collection_size(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n_docs, n_tokens of the documents with at least one token."""
    return docs.select(F.size(tokens(F.col(text_col))).alias("n")).where("n > 0").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


def search_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the terms asked for, stored; one row n_docs, n_tokens): texts are cut into words once.

    ``terms`` has a column term; other words leave before anything is shuffled.
    """
    size = Observation()
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    words = words.observe(size, F.count_if(F.size("w") > 0).alias("n_docs"), F.sum(F.size("w").cast("bigint")).alias("n_tokens"))
    rows = words.where(F.size("w") > 0).select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    asked = rows.join(terms.select("term").distinct(), "term", "left_semi")
    posts = materialize(asked.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("len").alias("len")), "postings")
    n = size.get
    return posts, docs.sparkSession.range(1).select(F.lit(n["n_docs"]).alias("n_docs"), F.lit(n["n_tokens"]).alias("n_tokens"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, term, qtf."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def drop_frequent_terms(terms: DataFrame, factor: float) -> DataFrame:
    """Drop terms with qtf above ``factor`` times the query's mean; keep all if none is left."""
    w = Window.partitionBy("query_id")
    marked = terms.withColumn("ok", F.col("qtf") <= factor * F.avg("qtf").over(w))
    return marked.withColumn("any_ok", F.max("ok").over(w)).where("ok OR NOT any_ok").drop("ok", "any_ok")


def bm25(tf: Column, length: Column, df: Column, n_docs: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def score_bm25(terms: DataFrame, posts: DataFrame, stats: DataFrame, size: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score."""
    known = terms.join(stats, "term").crossJoin(F.broadcast(size))  # size: one row
    hit = posts.join(known, "term")
    s = bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("n_docs"), F.col("n_tokens") / F.col("n_docs"), k1, b)
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * s), 6).alias("score"))


def score_query_likelihood(terms: DataFrame, posts: DataFrame, stats: DataFrame, size: DataFrame, mu: float = 1000.0) -> DataFrame:
    """Dirichlet-smoothed log likelihood; documents need at least one query term, unseen terms count half an occurrence."""
    known = terms.join(stats, "term", "left").crossJoin(F.broadcast(size)).withColumn("p", F.coalesce("cf", F.lit(0.5)) / F.col("n_tokens")).select("query_id", "term", "qtf", "p")
    hit = posts.join(known, "term").groupBy("query_id", "doc_id", "len").agg(F.sum(F.col("qtf") * (F.log((F.col("tf") + mu * F.col("p")) / (F.col("len") + mu)) - F.log(mu * F.col("p") / (F.col("len") + mu)))).alias("gain"))
    base = known.groupBy("query_id").agg(F.sum("qtf").alias("q_len"), F.sum(F.col("qtf") * F.log(mu * F.col("p"))).alias("q_log"))
    return hit.join(base, "query_id").select("query_id", "doc_id", F.round(F.col("gain") + F.col("q_log") - F.col("q_len") * F.log(F.col("len") + mu), 6).alias("score"))


def ranked(scores: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Ranks by falling score, then document; the limit reaches the partial sort."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


MODELS = {
    "bm25": lambda terms, posts, size: score_bm25(terms, posts, corpus_statistics(posts), size),
    "ql": lambda terms, posts, size: score_query_likelihood(terms, posts, corpus_statistics(posts), size, 1000.0),
}


def search(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, model: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each query (query_id, text) by a model of MODELS."""
    terms = materialize(query_terms(queries, "query_id", "text"), "terms")
    posts, size = search_index(docs, id_col, text_col, terms)
    return ranked(MODELS[model](terms, posts, size), k)
