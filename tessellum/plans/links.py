"""Queries that bring runs, judgements, pages and metadata together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import enrich
from ..storage import materialize
from . import base, corpus, evaluation, graphs, retrieval
from .tables import table

# -- page metadata ---------------------------------------------------------------------------


def _facts(spark: SparkSession, sf: str) -> list[DataFrame]:
    closure = materialize(corpus.redirect_closure(spark, sf), "closure")
    titles = base.fragments(spark, sf).where("title IS NOT NULL").select("id", "title")
    fixed = materialize(enrich.fix_links(base.links(spark, sf), closure, base.fragments(spark, sf).select("id")).where("NOT plain").select(F.col("target"), "src", "link_id"), "fixed")
    anchors = fixed.join(base.links(spark, sf).select("link_id", "anchor"), "link_id").where("anchor IS NOT NULL")
    first = base.links(spark, sf).groupBy("src").agg(F.min_by("dest", "link_id").alias("target"))
    named = first.join(titles.withColumnRenamed("id", "src"), "src")
    sections = base.fragments(spark, sf).where("parent IS NOT NULL AND title IS NOT NULL").select(F.col("parent").alias("target"), F.trim("title").alias("value"))
    return [
        enrich.facts(closure.where("target <> id").join(titles, "id"), "target", "redirect_name", F.col("title")),
        enrich.facts(named, "target", "disambiguation_name", F.col("title")),
        enrich.facts(named, "target", "disambiguation_id", F.col("src").cast("string")),
        enrich.facts(sections, "target", "category_name", F.col("value")),
        enrich.facts(fixed, "target", "inlink_id", F.col("src").cast("string")),
        enrich.facts(anchors, "target", "inlink_anchor", F.col("anchor")),
    ]


def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of every fragment as rows: field, value and how often it was seen."""
    return enrich.merge_facts(*_facts(spark, sf))


def page_metadata_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row a fragment: the number of different values of each field, 0 where there are none."""
    return enrich.attach_counts(base.fragments(spark, sf).select("id"), page_metadata(spark, sf))


_FACTS = f"""{corpus._REDIR}, {base.FRAG}, moved AS (SELECT l.link_id, l.src, l.anchor, coalesce(c.target, l.dest) AS target FROM link l LEFT JOIN closure c ON c.id = l.dest),
fixed AS (SELECT * FROM moved WHERE target IN (SELECT id FROM frag)),
first AS (SELECT src, arg_min(dest, link_id) AS target FROM link GROUP BY ALL),
fact AS (SELECT target, 'redirect_name' AS field, title AS value FROM closure JOIN frag USING (id) WHERE target <> id AND title IS NOT NULL
  UNION ALL SELECT target, 'disambiguation_name', title FROM first JOIN frag ON frag.id = src WHERE title IS NOT NULL
  UNION ALL SELECT target, 'disambiguation_id', CAST(src AS VARCHAR) FROM first JOIN frag ON frag.id = src WHERE title IS NOT NULL
  UNION ALL SELECT parent, 'category_name', trim(title, ' ') FROM frag WHERE parent IS NOT NULL AND title IS NOT NULL
  UNION ALL SELECT target, 'inlink_id', CAST(src AS VARCHAR) FROM fixed
  UNION ALL SELECT target, 'inlink_anchor', anchor FROM fixed WHERE anchor IS NOT NULL),
metadata AS (SELECT target, field, value, count(*) AS n FROM fact GROUP BY ALL)"""


# -- runs and judgements ---------------------------------------------------------------------


def benchmark_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many judged paragraphs, and how many run items of each method, the corpus has."""
    ids = base.paragraphs(spark, sf).select("id").withColumn("there", F.lit(1))
    asked = base.qrels(spark, sf).select(F.lit("judgements").alias("source"), F.col("doc_id").alias("id")).unionByName(base.runs(spark, sf).select(F.col("method").alias("source"), F.col("doc_id").alias("id"))).distinct()
    return asked.join(ids, "id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("there").alias("n_found"))


def reranked_by_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of each query ranked anew by their page's PageRank; those without one come behind in their old order."""
    pages = base.fragments(spark, sf).select(F.col("id").alias("entity"), F.col("page_id").alias("node"))
    scored = retrieval.entity_rank_by_passage(spark, sf).select("query_id", "entity", F.col("rank").alias("old_rank")).join(pages, "entity").join(graphs.pagerank(spark, sf), "node", "left")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "old_rank")
    return scored.select("query_id", "entity", "old_rank", "score", F.row_number().over(w).alias("rank"))


def pagerank_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Run entities whose page has no PageRank, by query."""
    return reranked_by_pagerank(spark, sf).groupBy("query_id").agg(F.count("score").alias("n_hit"), F.count_if(F.col("score").isNull()).alias("n_missed"))


def external_entities(spark: SparkSession, sf: str) -> DataFrame:
    """External names mapped to pages through redirects; unknown ones keep a marked name."""
    names = base.links(spark, sf).where("anchor IS NOT NULL").select("link_id", F.trim("anchor").alias("name"))
    known = base.fragments(spark, sf).where("title IS NOT NULL").select("id", F.trim("title").alias("name"))
    return enrich.map_entities(names, known, corpus.redirect_closure(spark, sf), strict=False)


def external_entities_strict(spark: SparkSession, sf: str) -> DataFrame:
    """As external_entities without the unknown ones, counted by page."""
    names = base.links(spark, sf).where("anchor IS NOT NULL").select("link_id", F.trim("anchor").alias("name"))
    known = base.fragments(spark, sf).where("title IS NOT NULL").select("id", F.trim("title").alias("name"))
    return enrich.map_entities(names, known, corpus.redirect_closure(spark, sf), strict=True).groupBy("entity").agg(F.count("*").alias("n"))


_NAMES = f"{corpus._REDIR}, {base.FRAG}, known AS (SELECT trim(title, ' ') AS name, coalesce(c.target, f.id) AS id FROM frag f LEFT JOIN closure c ON c.id = f.id WHERE title IS NOT NULL), names AS (SELECT link_id, trim(anchor, ' ') AS name FROM link WHERE anchor IS NOT NULL), hits AS (SELECT DISTINCT link_id, n.name, CAST(k.id AS VARCHAR) AS entity FROM names n JOIN known k USING (name))"


def run_items(spark: SparkSession, sf: str) -> DataFrame:
    """Run entries with their paragraph, and the fragment it is first placed in; entries without a paragraph go."""
    p = base.paragraphs(spark, sf).select(F.col("id").alias("doc_id"), F.length("content").alias("chars"))
    at = base.placements(spark, sf).groupBy(F.col("paragraph_id").alias("doc_id")).agg(F.min_by("fragment", "pf_id").alias("fragment"))
    return base.runs(spark, sf).where("method = 'cosine'").select("query_id", "doc_id", "score").join(p, "doc_id").join(at, "doc_id", "left").select("query_id", "doc_id", "score", "chars", "fragment")


def run_pages_assessed(spark: SparkSession, sf: str) -> DataFrame:
    """For each query of the ltr run: its entries and how many of them were judged; 0 without judgements."""
    r = base.runs(spark, sf).where("method = 'ltr'").select("query_id", "doc_id")
    return r.join(base.qrels(spark, sf).withColumn("j", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("j").alias("n_judged"))


def run_listing(spark: SparkSession, sf: str) -> DataFrame:
    """For each query and method the run of the latest time: its time and size; null times are earliest."""
    rows = table(spark, sf, "ranking_entry").select("query_id", F.explode("entry_method_names").alias("method"), "run_at").where("method IS NOT NULL AND method <> ''")
    n = rows.groupBy("query_id", "method", "run_at").agg(F.count("*").alias("n"))
    return n.groupBy("query_id", "method").agg(F.max(F.struct("run_at", "n")).alias("r")).select("query_id", "method", F.col("r.run_at").alias("run_at"), F.col("r.n").alias("n"))


def seeds_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Entity rankings without the fragments that the query's judged paragraphs stand in."""
    judged = base.qrels(spark, sf).where("rel > 0").select("query_id", F.col("doc_id").alias("paragraph_id"))
    seeds = judged.join(base.placements(spark, sf), "paragraph_id").select("query_id", F.col("fragment").alias("entity")).distinct()
    return retrieval.entity_rank_by_passage(spark, sf).join(seeds, ["query_id", "entity"], "left_anti").select("query_id", "entity", "rank")


def selected_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Run sizes of the queries asked for; an empty choice means all."""
    return evaluation.restricted(base.runs(spark, sf), "query_id", SELECTED).groupBy("query_id").agg(F.count("*").alias("n"))


SELECTED: list[str] = []


def exported_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages chosen by id or by name."""
    return evaluation.chosen(corpus._pages(spark, sf), "page_id", ["wkx:Orvane%20Basin"], "name", ["Resith Line", "Yeska Bridge"]).select("page", "name")


def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of the paragraphs in the first hundred duplicate pairs."""
    pairs = graphs.jaccard_dup_pairs(spark, sf).orderBy("a", "b").limit(100)  # the feature: a report of the first pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return base.paragraphs(spark, sf).join(ids, "id", "left_semi")


def paragraph_index_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of each paragraph followed by the titles its links lead to."""
    titles = base.fragments(spark, sf).where("title IS NOT NULL").select(F.col("id").alias("dest"), "title")
    named = base.links(spark, sf).where("paragraph IS NOT NULL").select(F.col("paragraph").alias("id"), "dest").distinct().join(titles, "dest").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("title")), " ").alias("names"))
    return base.paragraphs(spark, sf).join(named, "id", "left").select("id", F.concat_ws(" ", "content", "names").alias("text"))


def section_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Headings for each page by the votes of its categories (the first words of page names)."""
    votes = retrieval.section_recommend(spark, sf).select("category", "heading", "votes")
    page = base.fragments(spark, sf).where("parent IS NULL AND page_id IS NOT NULL").select(F.col("id").alias("page"), F.lower(F.regexp_extract(text.title_of_id(F.col("page_id")), "^([A-Za-z]+)", 1)).alias("category"))
    return page.join(votes, "category").groupBy("page", "heading").agg(F.sum("votes").alias("score"))


def section_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each section of a page with the three that follow it in order of id."""
    w = Window.partitionBy("root").orderBy("id")
    n = corpus._nodes(spark, sf).where("depth > 0").select("root", "id", *[F.lead("id", k).over(w).alias(f"n{k}") for k in (1, 2, 3)])
    return n.select("root", F.col("id").alias("a"), F.explode(F.array("n1", "n2", "n3")).alias("b")).where("b IS NOT NULL")


# -- assessments -----------------------------------------------------------------------------


def max_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The highest label each session gave for a query's paragraph."""
    rows = table(spark, sf, "assessments").where("relevance IS NOT NULL").groupBy("query_id", "paragraph_id", "session_id").agg(F.collect_set("relevance").alias("labels"))  # six grades at most
    return rows.select("query_id", "paragraph_id", "session_id", F.array_max("labels").alias("relevance"))


def training_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per method: run items, judged ones, and positive ones."""
    r = base.runs(spark, sf).select("query_id", "doc_id", "method").join(base.qrels(spark, sf), ["query_id", "doc_id"], "left")
    return r.groupBy("method").agg(F.count("*").alias("n"), F.count("rel").alias("n_judged"), F.count_if(F.col("rel") > 0).alias("n_positive"))


def assessed_page_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of which more than half of the ltr run's ten best are judged, and more than half of their neighbours too."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = base.runs(spark, sf).where("method = 'ltr'").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query_id", "doc_id", "rank")
    j = top.join(base.qrels(spark, sf).select("query_id", "doc_id", F.lit(1).alias("j")), ["query_id", "doc_id"], "left").withColumn("j", F.coalesce("j", F.lit(0)))
    pairs = j.withColumn("next", F.lead("j").over(Window.partitionBy("query_id").orderBy("rank")))
    ratios = pairs.groupBy("query_id").agg(F.avg("j").alias("labels"), F.avg(F.col("j") * F.col("next")).alias("pairs"))
    return ratios.where("labels > 0.5 AND pairs > 0.5").select("query_id", F.round("labels", 9).alias("labels"), F.round("pairs", 9).alias("pairs"))


def converted_assessments(spark: SparkSession, sf: str) -> DataFrame:
    """Old labels (one a facet) in the new form: the facet moves into the label's row, rows without a facet get the default one."""
    from ..operators import assess

    rows = table(spark, sf, "assessments").select("query_id", "paragraph_id", "facet_id", "relevance", "time_stamp").distinct()
    return assess.to_new_form(rows)


def merge_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Per query: states merged, rows left, and those that lost against a later one."""
    state = evaluation._state(spark, sf).where("relevance IS NOT NULL")
    before = state.groupBy("query_id").agg(F.count("*").alias("n_rows"), F.count_distinct("session_id").alias("n_sessions"))
    after = evaluation.assess_merge_latest(spark, sf).groupBy("query_id").agg(F.count("*").alias("n_left"))
    return before.join(after, "query_id").select("query_id", "n_rows", "n_sessions", "n_left", (F.col("n_rows") - F.col("n_left")).alias("n_lost"))


QUERIES = {
    f.__name__: f
    for f in (page_metadata, page_metadata_counts, benchmark_coverage, reranked_by_pagerank, pagerank_misses, external_entities, external_entities_strict, run_items, run_pages_assessed, run_listing, seeds_dropped, selected_queries, exported_pages, duplicate_texts, paragraph_index_text, section_votes, section_neighbours, max_labels, training_totals, assessed_page_gate, converted_assessments, merge_statistics)
}

_PR = f"{retrieval._ENT}, {base.FRAG}, pedge AS (SELECT x.page_id AS src, y.page_id AS dst, count(*) AS weight FROM link JOIN frag x ON x.id = src JOIN frag y ON y.id = dest WHERE x.page_id <> y.page_id GROUP BY ALL), {graphs._rank_sql('pedge')}, scored AS (SELECT query_id, entity, rank AS old_rank, round(r.score, 9) AS score FROM ents JOIN frag f ON f.id = entity LEFT JOIN r{graphs.ROUNDS} r ON r.node = f.page_id)"

SQL = {
    "page_metadata": f"WITH RECURSIVE {_FACTS} SELECT target, field, value, n FROM metadata",
    "page_metadata_counts": f"WITH RECURSIVE {_FACTS} SELECT id, " + ", ".join(f"count(*) FILTER (field = '{f}') AS {f}" for f in enrich.FIELDS) + " FROM frag LEFT JOIN metadata ON target = id GROUP BY id",
    "benchmark_coverage": f"WITH {base.QREL}, {base.RUN}, {base.PARA}, asked AS (SELECT 'judgements' AS source, doc_id FROM qrel UNION SELECT method, doc_id FROM run) SELECT source, count(*) AS n, count(id) AS n_found FROM asked LEFT JOIN para ON id = doc_id GROUP BY source",
    "reranked_by_pagerank": f"WITH {_PR} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, old_rank) AS rank FROM scored",
    "pagerank_misses": f"WITH {_PR} SELECT query_id, count(score) AS n_hit, count(*) - count(score) AS n_missed FROM scored GROUP BY query_id",
    "external_entities": f"WITH RECURSIVE {_NAMES} SELECT link_id, name, entity FROM hits UNION ALL SELECT link_id, name, 'undefined:' || name FROM names WHERE name NOT IN (SELECT name FROM known)",
    "external_entities_strict": f"WITH RECURSIVE {_NAMES} SELECT entity, count(*) AS n FROM hits GROUP BY entity",
    "run_items": f"WITH {base.RUN}, {base.PARA}, {base.PLACE}, at_ AS (SELECT paragraph_id, arg_min(fragment, pf_id) AS fragment FROM place GROUP BY ALL) SELECT query_id, doc_id, score, CAST(length(content) AS INTEGER) AS chars, fragment FROM run JOIN para ON id = doc_id LEFT JOIN at_ ON paragraph_id = doc_id WHERE method = 'cosine'",
    "run_pages_assessed": f"WITH {base.RUN}, {base.QREL} SELECT r.query_id, count(*) AS n, count(q.doc_id) AS n_judged FROM run r LEFT JOIN qrel q USING (query_id, doc_id) WHERE method = 'ltr' GROUP BY r.query_id",
    "run_listing": "WITH r AS (SELECT query_id, method, run_at, count(*) AS n FROM (SELECT query_id, unnest(entry_method_names) AS method, run_at FROM ranking_entry) WHERE method IS NOT NULL AND method <> '' GROUP BY ALL) SELECT query_id, method, run_at, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY run_at DESC NULLS LAST) AS k FROM r) WHERE k = 1",
    "seeds_dropped": f"WITH {retrieval._ENT}, {base.QREL}, {base.PLACE} SELECT query_id, entity, rank FROM ents WHERE (query_id, entity) NOT IN (SELECT query_id, fragment FROM qrel JOIN place ON paragraph_id = doc_id WHERE rel > 0)",
    "selected_queries": f"WITH {base.RUN} SELECT query_id, count(*) AS n FROM run GROUP BY ALL",
    "exported_pages": f"WITH {corpus._PAGES} SELECT page, name FROM pages WHERE page_id IN ('wkx:Orvane%20Basin') OR name IN ('Resith Line', 'Yeska Bridge')",
    "duplicate_texts": f"WITH {graphs._PAIRS}, f AS (SELECT a, b FROM pairs ORDER BY a, b LIMIT 100) SELECT id, content FROM para WHERE id IN (SELECT a FROM f UNION SELECT b FROM f)",
    "paragraph_index_text": f"WITH {base.PARA}, {base.LINK}, {base.FRAG}, n AS (SELECT paragraph AS id, string_agg(DISTINCT title, ' ' ORDER BY title) AS names FROM link JOIN frag f ON f.id = dest WHERE title IS NOT NULL AND paragraph IS NOT NULL GROUP BY paragraph) SELECT id, concat_ws(' ', content, names) AS text FROM para LEFT JOIN n USING (id)",
    "section_votes": f"WITH votes AS ({retrieval.SQL['section_recommend']}), f AS (SELECT id, lower(regexp_extract(url_decode(regexp_replace(page_id, '^[^:]*:', '')), '^([A-Za-z]+)', 1)) AS category FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, parent DESC NULLS LAST, title DESC NULLS LAST, page_id DESC NULLS LAST) AS rn FROM fragments WHERE id IS NOT NULL) WHERE rn = 1 AND parent IS NULL AND page_id IS NOT NULL) SELECT f.id AS page, heading, CAST(sum(votes) AS BIGINT) AS score FROM f JOIN votes USING (category) GROUP BY ALL",
    "section_neighbours": f"WITH RECURSIVE {corpus._TREE}, n AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM tnodes WHERE depth > 0) SELECT a.root, a.id AS a, b.id AS b FROM n a JOIN n b ON a.root = b.root AND b.k BETWEEN a.k + 1 AND a.k + 3",
    "max_labels": "SELECT query_id, paragraph_id, session_id, max(relevance) AS relevance FROM assessments WHERE relevance IS NOT NULL GROUP BY ALL",
    "training_totals": f"WITH {base.RUN}, {base.QREL} SELECT method, count(*) AS n, count(rel) AS n_judged, count(*) FILTER (rel > 0) AS n_positive FROM run LEFT JOIN qrel USING (query_id, doc_id) GROUP BY method",
    "assessed_page_gate": f"""WITH {base.RUN}, {base.QREL}, top AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM run WHERE method = 'ltr') WHERE rank <= 10),
        j AS (SELECT t.query_id, rank, (q.doc_id IS NOT NULL)::INT AS j FROM top t LEFT JOIN qrel q USING (query_id, doc_id)), p AS (SELECT *, lead(j) OVER (PARTITION BY query_id ORDER BY rank) AS nx FROM j)
        SELECT query_id, round(avg(j), 9) AS labels, round(avg(j * nx), 9) AS pairs FROM p GROUP BY query_id HAVING avg(j) > 0.5 AND avg(j * nx) > 0.5""",
    "converted_assessments": """WITH s AS (SELECT DISTINCT query_id, paragraph_id, coalesce(facet_id, 'none') AS facet, relevance, time_stamp FROM assessments),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paragraph_id, facet ORDER BY time_stamp DESC NULLS LAST, relevance DESC NULLS LAST) AS k FROM s) WHERE k = 1)
        SELECT query_id, paragraph_id, facet, CASE relevance WHEN 3 THEN 'must' WHEN 2 THEN 'should' WHEN 1 THEN 'can' WHEN 0 THEN 'nonrel' WHEN -2 THEN 'trash' ELSE 'unset' END AS label, coalesce(relevance = -2, false) AS hidden FROM l WHERE facet <> 'none' OR relevance IS NOT NULL""",
    "merge_statistics": f"WITH {evaluation._MERGED}, b AS (SELECT query_id, count(*) AS n_rows, count(DISTINCT session_id) AS n_sessions FROM state WHERE relevance IS NOT NULL GROUP BY ALL), a AS (SELECT query_id, count(*) AS n_left FROM merged GROUP BY ALL) SELECT query_id, n_rows, n_sessions, n_left, n_rows - n_left AS n_lost FROM b JOIN a USING (query_id)",
}
