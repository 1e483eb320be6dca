"""Row numbers of lists of any length.

A window orders a whole list in one task.  Lists of more than ``LONG_LIST`` rows are instead
ordered by a range partitioning of all rows: every partition numbers its own rows while it is
written, and the partitions' sizes say where each begins.  Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

LONG_LIST = 500_000
_BITS = 33  # of a row's number within its partition


def numbered(rows: DataFrame, order: list[Column], name: str = "k") -> DataFrame:
    """``rows`` with numbers from 1 in a total order, whatever their number; ties get any order."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(F.shiftright("_at", _BITS).alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # one row a partition
    own = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.withColumn("_part", F.shiftright("_at", _BITS)).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + own + 1).drop("_part", "_start", "_at")


def list_ranks(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", long_list: int = LONG_LIST) -> DataFrame:
    """``rows`` with the position of each in its list (``keys``) by ``order``, which must be total within a list."""
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= long_list:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    all_ = numbered(rows, [*[F.col(k).asc_nulls_first() for k in keys], *order], "_k")
    first = all_.groupBy(*keys).agg(F.min("_k").alias("_first")).select([F.col(k).alias(f"_{k}") for k in keys] + ["_first"])
    same = [all_[k].eqNullSafe(first[f"_{k}"]) for k in keys]
    return all_.join(first, same).withColumn(name, (F.col("_k") - F.col("_first") + 1).cast("int")).drop("_k", "_first", *[f"_{k}" for k in keys])
