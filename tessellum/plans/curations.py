"""Query texts, highlighting and checks of found duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem, text
from ..operators import curation
from . import base
from .graphs import _PAIRS, _sets, jaccard_dup_pairs
from .tables import table


def structured_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of the judged headings in a structured query language."""
    q = table(spark, sf, "assessments").select("query_id").where("query_id IS NOT NULL").distinct()
    t = text.title_of_id(F.col("query_id"))
    return q.select("query_id", curation.combined_query([curation.structured_query(t), curation.structured_query(t, "rm", "title")]).alias("query"))


def highlight_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Words of judged paragraphs that occur in a query they were judged for."""
    j = base.qrels(spark, sf).select("query_id", F.col("doc_id").alias("id"))
    keys = j.select("id", F.explode(text.stems(text.title_of_id(F.col("query_id")))).alias("stem"), F.lit("query").alias("source"))
    return curation.highlights(base.paragraphs(spark, sf).select("id", F.col("content").alias("text")), keys)


def low_edges_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return base.runs(spark, sf).where("method = 'walk_pagerank' AND score > 1e-7").select("query_id", "doc_id", "score")


def path_file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Query ids as file names."""
    q = table(spark, sf, "assessments").select("query_id").where("query_id IS NOT NULL").distinct()
    return q.select("query_id", F.translate("query_id", "/:%~", "-__.").alias("name"))


def dup_edge_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs above 0.8 that a search for paragraphs with the same first ten words misses."""
    first = _sets(spark, sf).join(base.paragraphs(spark, sf), "id").select("id", F.array_join(F.slice(text.tokens(F.col("content")), 1, 10), " ").alias("k"))
    expected = jaccard_dup_pairs(spark, sf).select("a", "b")
    found = expected.join(first.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(first.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b").where("ka = kb")
    return curation.missing_edges(expected, found.select("a", "b"))


def shared_page_names(spark: SparkSession, sf: str) -> DataFrame:
    """Systematic chunks of page ids: their smallest and largest member."""
    p = base.fragments(spark, sf).where("page_id IS NOT NULL").select("page_id").distinct()
    return p.groupBy(text.stable_bucket(F.col("page_id"), 20).alias("chunk")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))


QUERIES = {f.__name__: f for f in (structured_queries, highlight_spans, low_edges_dropped, path_file_names, dup_edge_recall, shared_page_names)}

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_WORDS = f"list_filter({text.tokens_sql("url_decode(regexp_replace(query_id, '^[^:]*:', ''))")}, lambda x: len(x) > 1 AND NOT list_contains({_STOP}, x))"
_STEM = f"{stem.stems_sql('[w]')}[1]"

SQL = {
    "structured_queries": f"""WITH q AS (SELECT DISTINCT query_id FROM assessments WHERE query_id IS NOT NULL), w AS (SELECT query_id, {_WORDS} AS w FROM q)
        SELECT query_id, CASE WHEN len(w) = 0 THEN '#combine()' ELSE '#combine(#sdm(' || array_to_string(w, ' ') || ') #rm(' || array_to_string(list_transform(w, lambda x: x || '.title'), ' ') || '))' END AS query FROM w""",
    "highlight_spans": f"""WITH {base.QREL}, {base.PARA}, k AS (SELECT DISTINCT id, {_STEM} AS stem FROM (SELECT doc_id AS id, unnest({_WORDS}) AS w FROM qrel)),
        t AS (SELECT id, {_STEM} AS stem FROM (SELECT id, unnest({text.tokens_sql('content')}) AS w FROM para)) SELECT id, stem, count(*) AS n, 'query' AS source FROM t JOIN k USING (id, stem) GROUP BY id, stem""",
    "low_edges_dropped": f"WITH {base.RUN} SELECT query_id, doc_id, score FROM run WHERE method = 'walk_pagerank' AND score > 1e-7",
    "path_file_names": "SELECT DISTINCT query_id, translate(query_id, '/:%~', '-__.') AS name FROM assessments WHERE query_id IS NOT NULL",
    "dup_edge_recall": f"WITH {_PAIRS}, f AS (SELECT id, array_to_string(w[:10], ' ') AS k FROM w) SELECT a, b FROM pairs JOIN f x ON x.id = a JOIN f y ON y.id = b WHERE x.k <> y.k",
    "shared_page_names": f"WITH {base.FRAG}, p AS (SELECT DISTINCT page_id AS name FROM frag WHERE page_id IS NOT NULL) SELECT ('0x' || substr(md5(name), 1, 8))::BIGINT % 20 AS chunk, count(*) AS n, min(name) AS first, max(name) AS last FROM p GROUP BY 1",
}
