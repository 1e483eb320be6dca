"""Retrieval, run handling and entity ranking queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stem, text
from ..operators import ranking
from ..operators import retrieval as ir
from ..storage import materialize
from . import base
from .tables import table

DEPTH = 10
HEADING = "regexp_extract(query_id, '/([^/~]*)(~|$)', 1)"


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    """The headings asked for, with their decoded text."""
    return table(spark, sf, "assessments").select(F.expr(HEADING).alias("query_id")).where("query_id <> ''").distinct().select("query_id", text.unescape_id(F.col("query_id")).alias("text"))


def _index(spark: SparkSession, sf: str):
    terms = materialize(ir.query_terms(_topics(spark, sf), "query_id", "text"), "terms")
    posts, size = ir.search_index(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", terms)
    return posts, ir.corpus_statistics(posts), size, terms


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    posts, stats, size, terms = _index(spark, sf)
    return ir.ranked(ir.score_bm25(terms, posts, stats, size), DEPTH)


def ql_dirichlet_topk(spark: SparkSession, sf: str) -> DataFrame:
    posts, stats, size, terms = _index(spark, sf)
    return ir.ranked(ir.score_query_likelihood(terms, posts, stats, size, 1000.0), DEPTH)


def ql_dirichlet_small_mu(spark: SparkSession, sf: str) -> DataFrame:
    posts, stats, size, terms = _index(spark, sf)
    return ir.ranked(ir.score_query_likelihood(terms, posts, stats, size, 100.0), DEPTH)


def paragraph_search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return ir.search(base.paragraphs(spark, sf), "id", "content", _topics(spark, sf), "bm25", DEPTH)


def paragraph_search_ql(spark: SparkSession, sf: str) -> DataFrame:
    return ir.search(base.paragraphs(spark, sf), "id", "content", _topics(spark, sf), "ql", DEPTH)


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """id, text: the title of each fragment and its first placed paragraph."""
    lead = base.placements(spark, sf).groupBy(F.col("fragment").alias("id")).agg(F.min_by("paragraph_id", "pf_id").alias("p"))
    p = base.paragraphs(spark, sf).select(F.col("id").alias("p"), "content")
    rows = base.fragments(spark, sf).select("id", "title").join(lead, "id", "left").join(p, "p", "left")
    return rows.select("id", F.concat_ws(" ", "title", "content").alias("text"))


def entity_search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return ir.search(_entities(spark, sf), "id", "text", _topics(spark, sf), "bm25", DEPTH)


def entity_search_ql(spark: SparkSession, sf: str) -> DataFrame:
    return ir.search(_entities(spark, sf), "id", "text", _topics(spark, sf), "ql", DEPTH)


def _edge_texts(spark: SparkSession, sf: str) -> DataFrame:
    """id, text: paragraphs with links, their content and anchors."""
    anchors = base.links(spark, sf).where("paragraph IS NOT NULL").groupBy(F.col("paragraph").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("anchor")), " ").alias("anchors"))
    return base.paragraphs(spark, sf).join(anchors, "id").select("id", F.concat_ws(" ", "content", "anchors").alias("text"))


def edge_doc_search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return ir.search(_edge_texts(spark, sf), "id", "text", _topics(spark, sf), "bm25", DEPTH)


def edge_doc_search_ql(spark: SparkSession, sf: str) -> DataFrame:
    return ir.search(_edge_texts(spark, sf), "id", "text", _topics(spark, sf), "ql", DEPTH)


def seed_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of each query: its five best entities, and for queries without any the targets that their judged paragraphs link to most."""
    best = entity_search_bm25(spark, sf).where("rank <= 5").select("query_id", F.col("doc_id").alias("entity"))
    heading = F.expr(HEADING)
    linked = base.qrels(spark, sf).where("rel > 0").select(heading.alias("query_id"), F.col("doc_id").alias("paragraph")).where("query_id <> ''").join(base.links(spark, sf).select("paragraph", F.col("dest").alias("entity")), "paragraph").groupBy("query_id", "entity").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "entity")
    other = linked.withColumn("k", F.row_number().over(w)).where("k <= 5").join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "entity")
    return best.withColumn("source", F.lit("index")).unionByName(other.withColumn("source", F.lit("links")))


def freq_term_drop(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("s"), "text")
    terms = ir.query_terms(docs, "s", "text")
    return ir.drop_frequent_terms(terms, 2.0)


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ir.corpus_statistics(ir.postings(table(spark, sf, "documents"), "doc_id", "text"))


def corpus_stats_merged(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    parts = [ir.corpus_statistics(ir.postings(docs.where(F.col("doc_id") % 2 == i), "doc_id", "text")) for i in (0, 1)]
    return ir.merge_statistics(*parts)


def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return ir.postings(table(spark, sf, "documents"), "doc_id", "text")


def bag_of_words(spark: SparkSession, sf: str) -> DataFrame:
    return ir.postings(base.paragraphs(spark, sf), "id", "content").select("doc_id", "term", "tf")


def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = text.content_tokens(F.col("content"))
    return base.paragraphs(spark, sf).select("id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_types"))


def stem_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every different word is stemmed once."""
    words = base.paragraphs(spark, sf).select(F.explode(text.content_tokens(F.col("content"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.select(stem.stem(F.col("w")).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


def stem_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words and signs of the paragraphs with their stems, counted."""
    rows = base.paragraphs(spark, sf).select(F.explode(text.text_or_punctuation(F.col("content"))).alias("t"))
    return rows.groupBy("t.token", "t.stem").agg(F.count("*").alias("n"))


def latin_words(spark: SparkSession, sf: str) -> DataFrame:
    """Latin content words of the page titles."""
    rows = base.fragments(spark, sf).where("title IS NOT NULL").select("id", text.latin_tokens(F.col("title")).alias("w"))
    return rows.select("id", F.array_join("w", " ").alias("words"))


def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return base.paragraphs(spark, sf).select(F.explode(text.adjacent_pairs(text.tokens(F.col("content")))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def run_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Rank numbers of every method's run."""
    return ranking.list_ranks(materialize(base.runs(spark, sf), "runs"), ["query_id", "method"], run_order())


def run_order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def _best(spark: SparkSession, sf: str, depth: int) -> DataFrame:
    """The first rows of each run: the window's limit is applied before the shuffle as well."""
    w = Window.partitionBy("query_id", "method").orderBy(*run_order())
    return base.runs(spark, sf).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def run_rank_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf, 20)


def run_pool_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The pool of every query: each method gives its ceil(30 / methods) best."""
    runs = materialize(base.runs(spark, sf), "runs")
    n = runs.select("query_id", "method").distinct().groupBy("query_id").agg(F.count("*").alias("n_methods"))
    w = Window.partitionBy("query_id", "method").orderBy(*run_order())
    top = runs.withColumn("rank", F.row_number().over(w)).where("rank <= 30").join(n, "query_id").where(F.col("rank") <= F.ceil(F.lit(30) / F.col("n_methods")))
    return top.groupBy("query_id", "doc_id").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"), F.max("score").alias("score"))


def run_method_counts(spark: SparkSession, sf: str) -> DataFrame:
    return run_pool_topk(spark, sf).select("query_id", F.explode(F.split("methods", ",")).alias("method")).groupBy("query_id", "method").agg(F.count("*").alias("n"))


def run_nub(spark: SparkSession, sf: str) -> DataFrame:
    """Over all methods the best row of each item, ranked anew."""
    first = run_ranked(spark, sf).groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", (-F.col("score")).alias("down"), "method")).alias("b")).select("query_id", "doc_id", "b.rank", "b.method")
    return ranking.list_ranks(materialize(first, "first"), ["query_id"], [F.asc("rank"), F.asc("method"), F.asc("doc_id")], "new_rank").select("query_id", "doc_id", "method", "new_rank")


def run_partition_recombine(spark: SparkSession, sf: str) -> DataFrame:
    """Per query and method: depth, best and worst score."""
    return base.runs(spark, sf).groupBy("query_id", "method").agg(F.count("*").alias("depth"), F.max("score").alias("best"), F.min("score").alias("worst"))


def run_line_format(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _best(spark, sf, 1000)
    return ranked.select(F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), "method").alias("line"))


def run_reciprocal_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal ranks of the 20 best, made to sum to 1."""
    top = _best(spark, sf, 20).withColumn("w", 1 / (F.col("rank") + 1))
    w = Window.partitionBy("query_id", "method")
    return top.select("query_id", "method", "doc_id", F.round(F.col("w") / F.sum("w").over(w), 9).alias("share"))


def rank_relative_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores against the fifth (or the last) of their list."""
    runs = materialize(base.runs(spark, sf), "runs")
    w = Window.partitionBy("query_id", "method").orderBy(*run_order())
    fifth = runs.withColumn("rank", F.row_number().over(w)).where("rank <= 5").groupBy("query_id", "method").agg(F.min("score").alias("pivot"))
    return runs.join(fifth, ["query_id", "method"]).select("query_id", "method", "doc_id", F.round(F.col("score") - F.col("pivot"), 6).alias("relative"))


def edge_rank_weights(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("rank")
    bucket = F.when(r <= 5, 3).when(r <= 20, 2).otherwise(1)
    return run_ranked(spark, sf).select("query_id", "method", "doc_id", bucket.alias("bucket"), F.round(1 / r, 9).alias("reciprocal"), F.greatest(101 - r, F.lit(0)).alias("linear"))


def entity_rank_by_passage(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments linked from a query's ranked paragraphs: supporting count and best score."""
    bm = base.runs(spark, sf).where("method = 'bm25'")
    linked = base.links(spark, sf).where("paragraph IS NOT NULL").select(F.col("paragraph").alias("doc_id"), F.col("dest").alias("entity")).distinct()
    scored = bm.join(linked, "doc_id").groupBy("query_id", "entity").agg(F.count("*").alias("n"), F.max(F.struct("score", "doc_id")).alias("m"))
    w = Window.partitionBy("query_id").orderBy(F.desc("m.score"), F.desc("n"), "entity")
    return scored.select("query_id", "entity", "n", F.col("m.score").alias("score"), F.col("m.doc_id").alias("passage"), F.row_number().over(w).alias("rank"))


def lead_passage_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked entities with their first placed paragraph; without one the row is dropped."""
    lead = base.placements(spark, sf).groupBy(F.col("fragment").alias("entity")).agg(F.min_by("paragraph_id", "pf_id").alias("lead"))
    return entity_rank_by_passage(spark, sf).select("query_id", "entity", "rank", "passage").join(lead, "entity").select("query_id", "entity", "rank", F.col("lead").alias("passage"))


def run_append_unmentioned(spark: SparkSession, sf: str) -> DataFrame:
    """Judged items missing from a query's bm25 run come behind it with score 0."""
    known = base.qrels(spark, sf).select("query_id", "doc_id")
    bm = base.runs(spark, sf).where("method = 'bm25'").select("query_id", "doc_id", "score")
    return known.join(bm, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def run_dummy_for_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Every judged query keeps a row, even if its ltr run is empty."""
    queries = base.qrels(spark, sf).select("query_id").distinct()
    best = base.runs(spark, sf).where("method = 'ltr'").groupBy("query_id").agg(F.max(F.struct("score", "doc_id")).alias("m"))
    return queries.join(best, "query_id", "left").select("query_id", F.coalesce("m.doc_id", F.lit("dummy")).alias("doc_id"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def section_recommend(spark: SparkSession, sf: str) -> DataFrame:
    """Headings voted for by the first word of the page names they stand under; ten a word."""
    f = base.fragments(spark, sf).where("title IS NOT NULL AND parent IS NOT NULL AND page_id IS NOT NULL")
    rows = f.select(F.lower(F.regexp_extract(text.title_of_id(F.col("page_id")), "^([A-Za-z]+)", 1)).alias("category"), F.trim("title").alias("heading")).where("category <> '' AND heading <> ''")
    votes = rows.groupBy("category", "heading").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("category").orderBy(F.desc("votes"), "heading")
    return votes.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def text_overlap_chunks(spark: SparkSession, sf: str) -> DataFrame:
    p = base.paragraphs(spark, sf).where("content IS NOT NULL AND content <> ''")
    return p.select("id", F.explode(text.overlapping_chunks(F.col("content"), 100, 20)).alias("c")).select("id", "c.offset", "c.chunk")


QUERIES = {f.__name__: f for f in (bm25_topk, ql_dirichlet_topk, ql_dirichlet_small_mu, paragraph_search_bm25, paragraph_search_ql, entity_search_bm25, entity_search_ql, edge_doc_search_bm25, edge_doc_search_ql, seed_entities, freq_term_drop, corpus_stats, corpus_stats_merged, inverted_index, bag_of_words, tokenize_stats, stem_counts, stem_tokens, latin_words, bigrams, run_ranked, run_rank_cutoff, run_pool_topk, run_method_counts, run_nub, run_partition_recombine, run_line_format, run_reciprocal_distribution, rank_relative_score, edge_rank_weights, entity_rank_by_passage, lead_passage_attach, run_append_unmentioned, run_dummy_for_empty, section_recommend, text_overlap_chunks)}

def _posts_sql(docs: str) -> str:
    """CTEs toks .. size over the rows (doc_id, text) of ``docs``."""
    return f"toks AS (SELECT doc_id, {text.tokens_sql('text')} AS w FROM {docs}), docs AS (SELECT doc_id, w, len(w) AS len FROM toks WHERE len(w) > 0), posts AS (SELECT term, doc_id, count(*) AS tf, CAST(max(len) AS INTEGER) AS len FROM (SELECT doc_id, len, unnest(w) AS term FROM docs) GROUP BY term, doc_id), stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posts GROUP BY term), size AS (SELECT count(*) AS n_docs, sum(len) AS n_tokens FROM docs)"


_POSTS = _posts_sql("documents")
_TERMS = f"topics AS (SELECT DISTINCT {HEADING} AS query_id FROM assessments), terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({text.tokens_sql('url_decode(query_id)')}) AS term FROM topics WHERE query_id <> '') GROUP BY ALL)"


def _ql(mu: float, posts: str = _POSTS) -> str:
    return f"""WITH {posts}, {_TERMS},
        known AS (SELECT query_id, term, qtf, coalesce(cf, 0.5) / n_tokens AS p FROM terms LEFT JOIN stats USING (term), size),
        hit AS (SELECT query_id, doc_id, len, sum(qtf * (ln((tf + {mu} * p) / (len + {mu})) - ln({mu} * p / (len + {mu})))) AS gain FROM posts JOIN known USING (term) GROUP BY ALL),
        base AS (SELECT query_id, sum(qtf) AS q_len, sum(qtf * ln({mu} * p)) AS q_log FROM known GROUP BY ALL),
        scored AS (SELECT query_id, doc_id, round(gain + q_log - q_len * ln(len + {mu}), 6) AS score FROM hit JOIN base USING (query_id))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {DEPTH}"""


def _bm25(posts: str = _POSTS) -> str:
    return f"""WITH {posts}, {_TERMS},
        scored AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (n_tokens / n_docs)))), 6) AS score
            FROM posts JOIN terms USING (term) JOIN stats USING (term), size GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {DEPTH}"""


_PARAGRAPHS = f"{base.PARA}, d AS (SELECT id AS doc_id, content AS text FROM para), {_posts_sql('d')}"
_ENTITIES = f"{base.FRAG}, {base.PARA}, {base.PLACE}, lead AS (SELECT fragment, arg_min(paragraph_id, pf_id) AS p FROM place GROUP BY ALL), d AS (SELECT f.id AS doc_id, concat_ws(' ', f.title, p.content) AS text FROM frag f LEFT JOIN lead l ON l.fragment = f.id LEFT JOIN para p ON p.id = l.p), {_posts_sql('d')}"
_EDGE_TEXTS = f"{base.PARA}, {base.LINK}, a AS (SELECT paragraph, string_agg(DISTINCT anchor, ' ' ORDER BY anchor) AS anchors FROM link WHERE paragraph IS NOT NULL GROUP BY ALL), d AS (SELECT id AS doc_id, concat_ws(' ', content, nullif(anchors, '')) AS text FROM para JOIN a ON a.paragraph = para.id), {_posts_sql('d')}"
_RANKED = f"{base.RUN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, doc_id) AS rank FROM run)"
_POOL = f"{_RANKED}, n AS (SELECT query_id, count(DISTINCT method) AS n_methods FROM run GROUP BY ALL), pool AS (SELECT query_id, doc_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, max(score) AS score FROM ranked JOIN n USING (query_id) WHERE rank <= ceil(30.0 / n_methods) GROUP BY ALL)"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_ENT = f"{base.RUN}, {base.LINK}, linked AS (SELECT DISTINCT paragraph AS doc_id, dest AS entity FROM link WHERE paragraph IS NOT NULL), ent AS (SELECT query_id, entity, count(*) AS n, max(struct_pack(s := score, d := doc_id)) AS m FROM run JOIN linked USING (doc_id) WHERE method = 'bm25' GROUP BY ALL), ents AS (SELECT query_id, entity, n, m.s AS score, m.d AS passage, row_number() OVER (PARTITION BY query_id ORDER BY m.s DESC, n DESC, entity) AS rank FROM ent)"

SQL = {
    "bm25_topk": _bm25(),
    "paragraph_search_bm25": _bm25(_PARAGRAPHS),
    "paragraph_search_ql": _ql(1000.0, _PARAGRAPHS),
    "entity_search_bm25": _bm25(_ENTITIES),
    "entity_search_ql": _ql(1000.0, _ENTITIES),
    "edge_doc_search_bm25": _bm25(_EDGE_TEXTS),
    "edge_doc_search_ql": _ql(1000.0, _EDGE_TEXTS),
    "seed_entities": f"""WITH best AS (SELECT query_id, doc_id AS entity FROM ({_bm25(_ENTITIES)}) WHERE rank <= 5), {base.LINK}, {base.QREL},
        linked AS (SELECT {HEADING} AS query_id, dest AS entity, count(*) AS n FROM qrel JOIN link ON paragraph = doc_id WHERE rel > 0 AND {HEADING} <> '' GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, entity) AS k FROM linked WHERE query_id NOT IN (SELECT query_id FROM best))
        SELECT query_id, entity, 'index' AS source FROM best UNION ALL SELECT query_id, entity, 'links' FROM k WHERE k <= 5""",
    "ql_dirichlet_topk": _ql(1000.0),
    "ql_dirichlet_small_mu": _ql(100.0),
    "freq_term_drop": f"""WITH terms AS (SELECT source AS query_id, term, count(*) AS qtf FROM (SELECT source, unnest({text.tokens_sql('text')}) AS term FROM documents WHERE source IS NOT NULL) GROUP BY ALL),
        marked AS (SELECT *, qtf <= 2.0 * avg(qtf) OVER (PARTITION BY query_id) AS ok FROM terms)
        SELECT query_id, term, qtf FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM marked) WHERE ok OR NOT any_ok""",
    "corpus_stats": f"WITH {_POSTS} SELECT term, df, cf FROM stats",
    "corpus_stats_merged": f"WITH {_POSTS} SELECT term, df, cf FROM stats",
    "inverted_index": f"WITH {_POSTS} SELECT * FROM posts",
    "bag_of_words": f"WITH {base.PARA} SELECT id AS doc_id, term, count(*) AS tf FROM (SELECT id, unnest({text.tokens_sql('content')}) AS term FROM para) GROUP BY ALL",
    "tokenize_stats": f"WITH {base.PARA}, w AS (SELECT id, coalesce(list_filter({text.tokens_sql('content')}, lambda x: len(x) > 1 AND NOT list_contains({_STOP}, x)), []) AS w FROM para) SELECT id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_types FROM w",
    "stem_counts": f"WITH {base.PARA}, w AS (SELECT unnest(list_filter({text.tokens_sql('content')}, lambda x: len(x) > 1 AND NOT list_contains({_STOP}, x))) AS w FROM para) SELECT stem, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {stem.stems_sql('[w]')}[1] AS stem, n FROM (SELECT w, count(*) AS n FROM w GROUP BY w)) GROUP BY stem",
    "stem_tokens": f"WITH {base.PARA}, t AS (SELECT unnest(regexp_extract_all(translate(lower(content), 'ς', 'σ'), '{text.WORD}|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]')) AS token FROM para), n AS (SELECT token, count(*) AS n, {stem.stems_sql('[token]')}[1] AS stem FROM t GROUP BY token) SELECT token, CASE WHEN regexp_matches(token, '^{text.WORD}$') AND length(stem) >= 3 AND NOT list_contains({_STOP}, token) THEN stem END AS stem, n FROM n",
    "latin_words": f"WITH {base.FRAG} SELECT id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[^a-z\u00df-\u00f6\u00f8-\u00ff]+', ' ', 'g'), ' '), lambda x: len(x) > 1 AND NOT list_contains({_STOP}, x)), ' ') AS words FROM frag WHERE title IS NOT NULL",
    "bigrams": f"WITH {base.PARA}, w AS (SELECT {text.tokens_sql('content')} AS w FROM para) SELECT w[i] || ' ' || w[i + 1] AS bigram, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1) GROUP BY 1",
    "run_ranked": f"WITH {_RANKED} SELECT * FROM ranked",
    "run_rank_cutoff": f"WITH {_RANKED} SELECT * FROM ranked WHERE rank <= 20",
    "run_pool_topk": f"WITH {_POOL} SELECT * FROM pool",
    "run_method_counts": f"WITH {_POOL} SELECT query_id, method, count(*) AS n FROM (SELECT query_id, unnest(string_split(methods, ',')) AS method FROM pool) GROUP BY ALL",
    "run_nub": f"WITH {_RANKED} SELECT query_id, doc_id, method, row_number() OVER (PARTITION BY query_id ORDER BY rank, method, doc_id) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, score DESC, method) AS k FROM ranked) WHERE k = 1",
    "run_partition_recombine": f"WITH {base.RUN} SELECT query_id, method, count(*) AS depth, max(score) AS best, min(score) AS worst FROM run GROUP BY ALL",
    "run_line_format": f"WITH {_RANKED} SELECT concat_ws(' ', query_id, 'Q0', doc_id, rank, method) AS line FROM ranked WHERE rank <= 1000",
    "run_reciprocal_distribution": f"WITH {_RANKED}, w AS (SELECT *, 1.0 / (rank + 1) AS w FROM ranked WHERE rank <= 20) SELECT query_id, method, doc_id, round(w::DOUBLE / sum(w::DOUBLE) OVER (PARTITION BY query_id, method), 9) AS share FROM w",
    "rank_relative_score": f"WITH {_RANKED} SELECT query_id, method, doc_id, round(score - coalesce(nth_value(score, 5) OVER w, last_value(score) OVER w), 6) AS relative FROM run WINDOW w AS (PARTITION BY query_id, method ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "edge_rank_weights": f"WITH {_RANKED} SELECT query_id, method, doc_id, CAST(CASE WHEN rank <= 5 THEN 3 WHEN rank <= 20 THEN 2 ELSE 1 END AS INTEGER) AS bucket, round(1.0::DOUBLE / rank, 9) AS reciprocal, greatest(101 - rank, 0) AS linear FROM ranked",
    "entity_rank_by_passage": f"WITH {_ENT} SELECT * FROM ents",
    "lead_passage_attach": f"WITH {_ENT}, {base.PLACE}, lead AS (SELECT fragment AS entity, arg_min(paragraph_id, pf_id) AS lead FROM place GROUP BY ALL) SELECT query_id, entity, rank, lead AS passage FROM ents JOIN lead USING (entity)",
    "run_append_unmentioned": f"WITH {base.QREL}, {base.RUN} SELECT q.query_id, q.doc_id, coalesce(r.score, 0.0) AS score FROM qrel q LEFT JOIN (SELECT * FROM run WHERE method = 'bm25') r USING (query_id, doc_id)",
    "run_dummy_for_empty": f"WITH {base.QREL}, {base.RUN}, b AS (SELECT query_id, max(struct_pack(s := score, d := doc_id)) AS m FROM run WHERE method = 'ltr' GROUP BY ALL) SELECT query_id, coalesce(m.d, 'dummy') AS doc_id, coalesce(m.s, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qrel) LEFT JOIN b USING (query_id)",
    "section_recommend": f"""WITH {base.FRAG}, rows AS (SELECT lower(regexp_extract(url_decode(regexp_replace(page_id, '^[^:]*:', '')), '^([A-Za-z]+)', 1)) AS category, trim(title, ' ') AS heading FROM frag WHERE title IS NOT NULL AND parent IS NOT NULL AND page_id IS NOT NULL),
        votes AS (SELECT category, heading, count(*) AS votes FROM rows WHERE category <> '' AND heading <> '' GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY votes DESC, heading) AS rank FROM votes) WHERE rank <= 10""",
    "text_overlap_chunks": f"WITH {base.PARA}, c AS (SELECT id, content, CAST(unnest(range(0, length(content), 100)) AS INTEGER) AS o FROM para WHERE content <> '') SELECT id, o AS \"offset\", substr(content, o + 1, 120) AS chunk FROM c",
}
