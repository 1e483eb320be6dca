"""Queries over parsed markup; documents serve as wiki texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup
from .tables import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "text")


def markup_pages(spark: SparkSession, sf: str) -> DataFrame:
    return markup.pages(_docs(spark, sf), "title", "text")


def markup_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes in reading order with their parents."""
    return markup.nodes(_docs(spark, sf), "title", "text").drop("links")


def markup_links(spark: SparkSession, sf: str) -> DataFrame:
    n = markup.nodes(_docs(spark, sf), "title", "text").select("page_id", F.explode("links").alias("l"))
    return n.select("page_id", "l.target", "l.anchor")


def first_list_links(spark: SparkSession, sf: str) -> DataFrame:
    """The first link of every list node."""
    n = markup.nodes(_docs(spark, sf), "title", "text").where("kind = 'list' AND size(links) > 0")
    return n.select("page_id", "node_id", F.element_at("links", 1).getField("target_id").alias("target_id"))


def markup_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of each page with their level."""
    return markup.nodes(_docs(spark, sf), "title", "text").where("kind = 'section'").groupBy("page_id", "level").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (markup_pages, markup_nodes, markup_links, first_list_links, markup_outline)}

SQL = {
    "markup_outline": r"""WITH lines AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\n')), ' ' || chr(9) || chr(13) || chr(160)) AS line FROM documents WHERE text IS NOT NULL)
        SELECT 'wiki:Doc%20' || doc_id AS page_id, CAST(length(regexp_extract(line, '^(=+)', 1)) AS INTEGER) AS level, count(*) AS n FROM lines WHERE regexp_matches(line, '^(==|===|====) [^=]+ (==|===|====)$') GROUP BY ALL""",
}
