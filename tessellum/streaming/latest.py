"""Structured Streaming forms of the stateful operators.

Each takes a streaming DataFrame of events (event_id, ts, user_id, event_type, value) and
returns a streaming DataFrame; ``run_to_table`` drives one over all data that is there and
returns the table it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # as a pattern: the stream source takes a single file only so
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_state(events: DataFrame) -> DataFrame:
    """The latest event by its own time; late ones lose however they arrive."""
    return events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


def windowed_counts(events: DataFrame, late: str = "10 days", width: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 days") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_of_each(events: DataFrame, most: int) -> DataFrame:
    """The first ``most`` events that arrive of every user; the state is one number a user."""

    def step(key: tuple, frames: Iterator, state: Any) -> Iterator:
        n = state.get[0] if state.exists else 0
        for frame in frames:
            part = frame.sort_values("event_id").head(max(0, most - n))
            n += len(part)
            if len(part):
                yield part.assign(user_id=key[0])[["user_id", "event_id"]]
        state.update((n,))

    return events.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint", "n bigint", "append", "NoTimeout")


def run_to_table(stream: DataFrame, keys: list[str], mode: str = "complete") -> DataFrame:
    """Process all available data; ``complete`` and ``update`` keep the last row of each key."""
    spark = stream.sparkSession
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/rows").drop("batch")
    if mode == "append":
        return rows.drop("_batch")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("last"))
        return rows.join(F.broadcast(last), F.col("_batch") == F.col("last")).drop("_batch", "last")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])
