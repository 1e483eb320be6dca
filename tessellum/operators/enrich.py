"""Redirects, inlinks and link rewriting."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, load, store


def redirect_closure(redirects: DataFrame) -> DataFrame:
    """(id, target, section): follow (id, dest, section) to its end; the last non-null section counts.

    Pointers double, so a chain of length n takes log2(n) joins.  A chain that runs into a
    circle leads nowhere: its members keep their own id and no section.
    """
    spark = redirects.sparkSession
    start = redirects.where("id IS NOT NULL AND dest IS NOT NULL").groupBy("id").agg(F.min(F.struct("dest", "section")).alias("r")).select("id", F.col("r.dest").alias("dest"), F.col("r.section").alias("section"))
    path = store(start, "redirects")
    state, rounds = load(spark, path, start), 0
    total = state.count()
    while True:
        step = state.select(F.col("id").alias("s_id"), F.col("dest").alias("s_dest"), F.col("section").alias("s_section"))
        open_ = state.join(step, F.col("dest") == F.col("s_id"), "left_semi").limit(1).count()
        if not open_ or 2**rounds > total:
            break
        after = state.join(step, F.col("dest") == F.col("s_id"), "left").select("id", F.coalesce("s_dest", "dest").alias("dest"), F.coalesce("s_section", "section").alias("section"))
        new = store(after, "redirects")
        discard(spark, path)
        path, state, rounds = new, load(spark, new, start), rounds + 1
    circle = state.select(F.col("id").alias("c_id"))
    joined = state.join(circle, F.col("dest") == F.col("c_id"), "left")
    return joined.select("id", F.when(F.col("c_id").isNull(), F.col("dest")).otherwise(F.col("id")).alias("target"), F.when(F.col("c_id").isNull(), F.col("section")).alias("section"))


def fix_links(links: DataFrame, closure: DataFrame, known: DataFrame) -> DataFrame:
    """Links with their final target and section; ``plain`` where the target is unknown.

    The redirect's section wins over the link's own.  ``known``: id of the existing targets.
    """
    c = closure.select(F.col("id").alias("dest"), F.col("target"), F.col("section").alias("r_section"))
    k = known.select(F.col("id").alias("target"), F.lit(True).alias("exists"))
    moved = links.join(c, "dest", "left").withColumn("target", F.coalesce("target", "dest"))
    return moved.join(k, "target", "left").select("link_id", "src", "dest", "target", F.coalesce("r_section", "anchor").alias("section"), F.col("exists").isNull().alias("plain"))


FIELDS = ("redirect_name", "disambiguation_name", "disambiguation_id", "category_name", "inlink_id", "inlink_anchor")


def facts(rows: DataFrame, target: str, field: str, value: Column) -> DataFrame:
    """(target, field, value, n): what one kind of row says about its target, added up before it is merged."""
    return rows.where(value.isNotNull()).groupBy(F.col(target).alias("target"), F.lit(field).alias("field"), value.alias("value")).agg(F.count("*").alias("n"))


def merge_facts(*parts: DataFrame) -> DataFrame:
    """Facts of several sources or partial runs as one; the order does not matter.

    Facts stay rows, so a target with a third of all links is no single row.
    """
    return functools.reduce(DataFrame.unionByName, parts).groupBy("target", "field", "value").agg(F.sum("n").alias("n"))


def attach_counts(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, a column for each of FIELDS): the number of different values; 0 without any."""
    n = metadata.groupBy(F.col("target").alias("id")).agg(*[F.count_if(F.col("field") == f).alias(f) for f in FIELDS])
    return pages.join(n, "id", "left").select("id", *[F.coalesce(f, F.lit(0)).alias(f) for f in FIELDS])


def map_entities(names: DataFrame, known: DataFrame, closure: DataFrame, strict: bool) -> DataFrame:
    """Rows of ``names`` (with a column name) for each page of that name, redirects followed, as ``entity``.

    A name may lead to several pages.  Names without a page go if ``strict``, else their entity
    is ``undefined:`` and the name.
    """
    ends = known.join(closure.select("id", "target"), "id", "left").select("name", F.coalesce("target", "id").cast("string").alias("entity")).distinct()
    out = names.join(ends, "name", "inner" if strict else "left")
    return out.withColumn("entity", F.coalesce("entity", F.concat(F.lit("undefined:"), "name")))


def anchor_histogram(links: DataFrame) -> DataFrame:
    """target, anchors: its anchor texts with counts, most frequent first."""
    n = links.where("anchor IS NOT NULL").groupBy("target", "anchor").agg(F.count("*").alias("n"))
    return n.groupBy("target").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "anchor"))).alias("l")).select("target", F.transform("l", lambda x: F.concat(x["anchor"], F.lit("="), (-x["down"]).cast("string"))).alias("anchors"))
