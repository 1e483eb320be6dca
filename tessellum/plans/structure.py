"""Queries over the fragment tree and over references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, references
from .tables import table


def _hierarchy(spark: SparkSession, sf: str, paths: bool = True) -> hierarchy.Hierarchy:
    return hierarchy.resolve(hierarchy.latest_nodes(table(spark, sf, "fragments")), paths)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.cycles(_hierarchy(spark, sf, paths=False).unreached)


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _hierarchy(spark, sf).nodes
    return nodes.select("id", F.array_join("title_path", " / ").alias("path"), "depth", "root", "orphan")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(_hierarchy(spark, sf).nodes)


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    links, placed = table(spark, sf, "links"), table(spark, sf, "paragraph_fragments")
    fragments = references.parent_keys(table(spark, sf, "fragments"), "id", text=False)
    paragraphs = references.parent_keys(table(spark, sf, "paragraphs"), "id", text=True)
    to_fragments = references.reference_rows(links, "links", "dest_fragment", "link_id", text=False)
    to_paragraphs = references.reference_rows(links, "links", "paragraph", "link_id", text=True).unionByName(references.reference_rows(placed, "paragraph_fragments", "paragraph_id", "pf_id", text=True))
    return references.find_orphans(to_fragments, fragments, text=False).unionByName(references.find_orphans(to_paragraphs, paragraphs, text=True))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "field_name", "row_id", "reason")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Misses per table, field, month and reason."""
    return _orphans(spark, sf).groupBy("table_name", "field_name", F.date_format("loaded_at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p5_found, p5_report)}

_NODES = """
nodes AS (
  SELECT id, parent, coalesce(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS title FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, parent DESC NULLS LAST, title DESC NULLS LAST) AS rn
    FROM fragments WHERE id IS NOT NULL) WHERE rn = 1),
roots AS (SELECT n.*, n.parent IS NOT NULL AS orphan FROM nodes n WHERE n.parent IS NULL OR n.parent NOT IN (SELECT id FROM nodes)),
tree AS (
  SELECT id, title AS path, 0 AS depth, id AS root, orphan, [id] AS ids, [title] AS titles FROM roots
  UNION ALL
  SELECT n.id, t.path || ' / ' || n.title, t.depth + 1, t.root, t.orphan, list_append(t.ids, n.id), list_append(t.titles, n.title) FROM tree t JOIN nodes n ON n.parent = t.id)
"""

_REFS = """
refs AS (
  SELECT DISTINCT 'links' AS table_name, 'dest_fragment' AS field_name, link_id AS row_id, CAST(dest_fragment AS VARCHAR) AS k, 'f' AS p, loaded_at FROM links WHERE dest_fragment IS NOT NULL
  UNION ALL SELECT DISTINCT 'links', 'paragraph', link_id, paragraph, 'p', loaded_at FROM links WHERE paragraph IS NOT NULL
  UNION ALL SELECT DISTINCT 'paragraph_fragments', 'paragraph_id', pf_id, paragraph_id, 'p', loaded_at FROM paragraph_fragments WHERE paragraph_id IS NOT NULL),
keys AS (
  SELECT 'f' AS p, CAST(id AS VARCHAR) AS k, min(loaded_at) AS first, min(deleted_at) AS gone FROM fragments WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'p', id, min(loaded_at), min(deleted_at) FROM paragraphs WHERE id IS NOT NULL GROUP BY id),
misses AS (
  SELECT r.*, CASE WHEN k2.k IS NULL THEN 'missing' WHEN k2.gone <= r.loaded_at THEN 'deleted' WHEN k2.first > r.loaded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN keys k2 ON r.p = k2.p AND r.k = k2.k)
"""

SQL = {
    "p1_hierarchy": f"WITH RECURSIVE {_NODES} SELECT id, path, depth, root, orphan FROM tree",
    "p1_descendants": f"WITH RECURSIVE {_NODES} SELECT ids[i] AS ancestor, id, len(ids) - i AS distance FROM (SELECT id, ids, unnest(range(1, len(ids))) AS i FROM tree WHERE depth > 0)",
    "p1_found": f"""WITH RECURSIVE {_NODES},
        lost AS (SELECT id, parent FROM nodes WHERE id NOT IN (SELECT id FROM tree)),
        walk AS (SELECT id AS start, parent AS cur FROM lost UNION SELECT w.start, l.parent FROM walk w JOIN lost l ON l.id = w.cur)
        SELECT CAST(min(cur) AS INTEGER) AS cycle_id, CAST(start AS INTEGER) AS id FROM walk GROUP BY start HAVING bool_or(start = cur)""",
    "p5_found": f"WITH {_REFS} SELECT table_name, field_name, row_id, reason FROM misses WHERE reason IS NOT NULL",
    "p5_report": f"WITH {_REFS} SELECT table_name, field_name, strftime(loaded_at, '%Y-%m') AS period, reason, count(*) AS n FROM misses WHERE reason IS NOT NULL GROUP BY ALL",
}
