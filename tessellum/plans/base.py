"""The corpus views that the queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """id, parent, title, page_id, deleted: the latest row of each fragment, titles as stored."""
    row = F.struct("loaded_at", "parent", "title", "page_id", F.col("deleted_at").isNotNull().alias("deleted"))
    latest = table(spark, sf, "fragments").where("id IS NOT NULL").groupBy("id").agg(F.max(row).alias("r"))
    return latest.select("id", "r.parent", "r.title", "r.page_id", "r.deleted")


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """id, content of the latest row of each paragraph."""
    latest = table(spark, sf, "paragraphs").where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("loaded_at", "content")).alias("r"))
    return latest.select("id", "r.content")


def links(spark: SparkSession, sf: str) -> DataFrame:
    """link_id, src, dest, paragraph, anchor without repeated rows; dest not null."""
    return table(spark, sf, "links").where("dest_fragment IS NOT NULL").select("link_id", F.col("src_fragment").alias("src"), F.col("dest_fragment").alias("dest"), "paragraph", "anchor").distinct()


def placements(spark: SparkSession, sf: str) -> DataFrame:
    """paragraph_id, fragment, pf_id (the first placing)."""
    return table(spark, sf, "paragraph_fragments").where("paragraph_id IS NOT NULL AND fragment IS NOT NULL").groupBy("paragraph_id", "fragment").agg(F.min("pf_id").alias("pf_id"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, doc_id, method, score: each scored item of each method once, with its best score."""
    rows = table(spark, sf, "ranking_entry").where("entry_item IS NOT NULL AND entry_score IS NOT NULL AND NOT isnan(entry_score)")
    methods = F.array_distinct(F.filter("entry_method_names", lambda m: m.isNotNull() & (m != "")))
    return rows.select("query_id", F.col("entry_item").alias("doc_id"), F.explode(methods).alias("method"), "entry_score").groupBy("query_id", "doc_id", "method").agg(F.max("entry_score").alias("score"))


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, doc_id, assessor, rel, ts: each assessor's latest label; nulls and unnamed assessors left out."""
    people = table(spark, sf, "assessment_metadata").select("session_id", F.explode("annotator_ids").alias("a")).where("a IS NOT NULL").select("session_id", F.lower(F.trim("a")).alias("assessor")).distinct()
    rows = table(spark, sf, "assessments").where("relevance IS NOT NULL").select("query_id", F.col("paragraph_id").alias("doc_id"), "session_id", "relevance", "time_stamp")
    latest = rows.join(people, "session_id").groupBy("query_id", "doc_id", "assessor").agg(F.max(F.struct("time_stamp", "relevance")).alias("r"))
    return latest.select("query_id", "doc_id", "assessor", F.col("r.relevance").alias("rel"), F.col("r.time_stamp").alias("ts"))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, doc_id, rel: the highest label of any assessor."""
    return judgements(spark, sf).groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))


FRAG = "frag AS (SELECT id, parent, title, page_id, deleted FROM (SELECT *, deleted_at IS NOT NULL AS deleted, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, parent DESC NULLS LAST, title DESC NULLS LAST, page_id DESC NULLS LAST, (deleted_at IS NOT NULL) DESC) AS rn FROM fragments WHERE id IS NOT NULL) WHERE rn = 1)"
PARA = "para AS (SELECT id, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM paragraphs WHERE id IS NOT NULL) WHERE rn = 1)"
LINK = "link AS (SELECT DISTINCT link_id, src_fragment AS src, dest_fragment AS dest, paragraph, anchor FROM links WHERE dest_fragment IS NOT NULL)"
PLACE = "place AS (SELECT paragraph_id, fragment, min(pf_id) AS pf_id FROM paragraph_fragments WHERE paragraph_id IS NOT NULL AND fragment IS NOT NULL GROUP BY ALL)"
RUN = "run AS (SELECT query_id, doc_id, method, max(entry_score) AS score FROM (SELECT query_id, entry_item AS doc_id, unnest(entry_method_names) AS method, entry_score FROM ranking_entry WHERE entry_item IS NOT NULL AND entry_score IS NOT NULL AND NOT isnan(entry_score)) WHERE method IS NOT NULL AND method <> '' GROUP BY ALL)"
JUDGE = """people AS (SELECT DISTINCT session_id, lower(trim(a)) AS assessor FROM (SELECT session_id, unnest(annotator_ids) AS a FROM assessment_metadata) WHERE a IS NOT NULL),
judge AS (SELECT query_id, paragraph_id AS doc_id, assessor, relevance AS rel, time_stamp AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, paragraph_id, assessor ORDER BY time_stamp DESC NULLS LAST, relevance DESC) AS rn FROM assessments JOIN people USING (session_id) WHERE relevance IS NOT NULL) WHERE rn = 1)"""
QREL = f"{JUDGE}, qrel AS (SELECT query_id, doc_id, max(rel) AS rel FROM judge GROUP BY ALL)"
