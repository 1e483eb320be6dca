"""Queries of the optional operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..storage import materialize
from . import bpe, consensus, fusion, neardup, packing, sentences, topn


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return topn.list_rows(table(spark, sf, "ranking_entry"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.leaders(_lists(spark, sf), least_methods=3, least_items=5)


def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_lists(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_top_items(spark, sf).select("query_id", "method", "entry_item")


def p3_top_items(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(_lists(spark, sf), ["query_id", "method"], "entry_item", "entry_score", 5)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.pairs_of_ids(neardup.near_duplicates(table(spark, sf, "paragraphs")))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(neardup.near_duplicates(table(spark, sf, "paragraphs")))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of equal sets with their members and the links between classes."""
    return neardup.classes_and_links(neardup.near_duplicates(table(spark, sf, "paragraphs")))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.person_labels(table(spark, sf, "assessments"), table(spark, sf, "assessment_metadata"))


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.consensus(consensus.fit(_labels(spark, sf)))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_items(spark, sf).where("n_labels >= 3").select("query_id", "paragraph_id", "relevance")


def p6_annotators(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.reliability(consensus.fit(_labels(spark, sf)))


def p6_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.krippendorff(_labels(spark, sf))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"))


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, sf, "documents")))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are and how alike the documents within one."""
    sizes = materialize(packing.sized(table(spark, sf, "documents")), "sizes")
    return packing.report(packing.pack(sizes), sizes)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_ranking, p3_found, p3_top_items, p4_found, p4_groups, p4_classes, p6_found, p6_items, p6_annotators, p6_alpha, p7_ids, p8_packing, p8_report, p9_found)}

_LISTS = """
lists AS (
  SELECT query_id, method, entry_item, max(entry_score) AS entry_score FROM (
    SELECT query_id, unnest(entry_method_names) AS method, entry_item, entry_score FROM ranking_entry
    WHERE entry_item IS NOT NULL AND entry_score IS NOT NULL AND NOT isnan(entry_score))
  WHERE method IS NOT NULL AND method <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY entry_score DESC, entry_item) AS rank FROM lists)
"""

_LABELS = r"""
people AS (SELECT DISTINCT session_id, annotator FROM (SELECT session_id, lower(regexp_replace(unnest(annotator_ids), '^\s+|\s+$', '', 'g')) AS annotator FROM assessment_metadata)
           WHERE session_id IS NOT NULL AND annotator <> ''),
labels AS (SELECT query_id, paragraph_id, annotator, relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, paragraph_id, annotator ORDER BY time_stamp DESC NULLS LAST, loaded_at DESC NULLS LAST, relevance DESC) AS rn
  FROM assessments JOIN people USING (session_id) WHERE relevance IS NOT NULL AND query_id IS NOT NULL AND paragraph_id IS NOT NULL) WHERE rn = 1)
"""



def _normal_quantile_sql(p: str) -> str:
    def poly(c: tuple, x: str) -> str:
        out = repr(c[-1])
        for v in c[-2::-1]:
            out = f"(({out}) * {x} + {v!r})"
        return out

    def ratio(t: tuple, x: str) -> str:
        return f"({poly(t[0], x)} / {poly(t[1], x)})"

    q, r = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    central, near, far = ratio(fusion.CENTRAL, f"(0.180625::DOUBLE - {q} * {q})"), ratio(fusion.TAIL, f"({r} - 1.6::DOUBLE)"), ratio(fusion.FAR_TAIL, f"({r} - 5.0::DOUBLE)")
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {central} ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {near} ELSE {far} END END"


_FUSED = f"""{_LISTS},
placed AS (SELECT *, rank() OVER up AS lo, count(*) OVER up AS hi, count(*) OVER (PARTITION BY query_id, method) AS n FROM lists WINDOW up AS (PARTITION BY query_id, method ORDER BY entry_score)),
percent AS (SELECT *, (((lo + hi) / 2.0::DOUBLE - 0.5::DOUBLE) / n)::DOUBLE AS p FROM placed),
totals AS (SELECT query_id, entry_item, sum({_normal_quantile_sql("p")}) AS total FROM percent GROUP BY ALL),
per_query AS (SELECT query_id, count(DISTINCT method) AS n_methods FROM lists GROUP BY ALL)
"""

# each id of the test tables has one content
_LIKE = r"""
w AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM paragraphs WHERE id IS NOT NULL AND content IS NOT NULL),
m AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)),
sets AS (SELECT id, list_sort(list(g)) AS s FROM m GROUP BY id),
shared AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS k FROM m x JOIN m y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
alike AS (SELECT id_a, id_b FROM shared JOIN sets a ON a.id = id_a JOIN sets b ON b.id = id_b WHERE 2 * k >= len(a.s) + len(b.s) - k)"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH {_FUSED}, heads AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, entry_item) AS rn, count(*) OVER (PARTITION BY query_id) AS n_items FROM totals)
        SELECT h.query_id, h.entry_item FROM heads h JOIN per_query q ON h.query_id IS NOT DISTINCT FROM q.query_id WHERE rn = 1 AND n_items >= 5 AND n_methods >= 3""",
    "p2_ranking": f"""WITH {_FUSED}, means AS (SELECT t.query_id, t.entry_item, round(total / n_methods, 9) AS score FROM totals t JOIN per_query q ON t.query_id IS NOT DISTINCT FROM q.query_id)
        SELECT query_id, entry_item, score, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM means""",
    "p3_found": f"WITH {_LISTS} SELECT query_id, method, entry_item FROM ranked WHERE rank <= 5",
    "p3_top_items": f"WITH {_LISTS} SELECT query_id, method, entry_item, entry_score + 0.0 AS entry_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5",
    "p4_found": f"WITH {_LIKE} SELECT id_a, id_b FROM alike",
    "p4_groups": f"""WITH RECURSIVE {_LIKE}, ends AS (SELECT id_a AS x, id_b AS y FROM alike UNION SELECT id_b, id_a FROM alike),
        reach AS (SELECT x, y FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON e.x = r.y),
        n AS (SELECT k.id, count(DISTINCT o.s) AS n_links FROM sets k JOIN alike p ON k.id IN (p.id_a, p.id_b) JOIN sets o ON o.id IN (p.id_a, p.id_b) AND o.id <> k.id AND o.s <> k.s GROUP BY ALL)
        SELECT x AS id, least(x, min(y)) AS group_id, coalesce(any_value(n_links), 0) AS n_links FROM reach LEFT JOIN n ON n.id = x GROUP BY x""",
    "p6_alpha": f"""WITH {_LABELS},
        items AS (SELECT count(*) AS n, sum(relevance) AS s, sum(relevance * relevance) AS ss FROM labels GROUP BY query_id, paragraph_id HAVING count(*) > 1),
        t AS (SELECT count(*) AS n_items, sum(n) AS n_labels, sum(s) AS s, sum(ss) AS ss, sum(2.0 * (n * ss - s * s) / (n - 1)) AS d FROM items)
        SELECT n_items, CAST(n_labels AS BIGINT) AS n_labels, 1 - (d / n_labels) / (2.0 * (n_labels * ss - s * s) / (n_labels * (n_labels - 1.0))) AS alpha FROM t""",
}
