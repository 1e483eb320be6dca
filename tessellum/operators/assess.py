"""Assessment state: merging, filtering and cleaning timestamped labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Grades of the named labels; labels without a grade map to null.
GRADES = {"must": 3, "should": 2, "can": 1, "topic": 0, "nonrel": 0, "trash": -2, "duplicate": None, "unset": None}


def latest(rows: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """The latest row of each key; later columns of ``ties`` decide among equal times (larger wins)."""
    rest = [c for c in rows.columns if c not in keys]
    order = [time, *ties, *[c for c in rest if c not in (time, *ties)]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def grade_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in GRADES.items() if v is not None for x in (k, v)])
    return F.element_at(table, F.lower(label))


def label_of(grade: Column) -> Column:
    return F.when(grade == 3, "must").when(grade == 2, "should").when(grade == 1, "can").when(grade == 0, "nonrel").when(grade == -2, "trash").otherwise("unset")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with the value of the row before; the first of a group has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w))


def to_new_form(rows: DataFrame, default_facet: str = "none") -> DataFrame:
    """(query_id, paragraph_id, facet, label, hidden) from labels of the old form, one grade a facet.

    The latest grade counts.  Rows with neither facet nor grade go; paragraphs graded as trash are hidden.
    """
    facet = F.coalesce("facet_id", F.lit(default_facet))
    last = rows.groupBy("query_id", "paragraph_id", facet.alias("facet")).agg(F.max(F.struct("time_stamp", "relevance")).alias("r"))
    out = last.select("query_id", "paragraph_id", "facet", label_of(F.col("r.relevance")).alias("label"), F.coalesce(F.col("r.relevance") == -2, F.lit(False)).alias("hidden"))
    return out.where((F.col("facet") != default_facet) | (F.col("label") != "unset"))
