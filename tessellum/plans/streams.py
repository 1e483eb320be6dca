"""Streaming queries, run over all data that is there; the SQL is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import latest


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return latest.event_stream(spark, f"{sf}/events.parquet")


def streaming_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return latest.run_to_table(latest.latest_state(_events(spark, sf)), ["user_id", "event_type"], "update")


def streaming_windows(spark: SparkSession, sf: str) -> DataFrame:
    return latest.run_to_table(latest.windowed_counts(_events(spark, sf)), ["start", "event_type"], "update")


def streaming_running_count(spark: SparkSession, sf: str) -> DataFrame:
    return latest.run_to_table(latest.first_of_each(_events(spark, sf), 3), ["user_id", "event_id"], "append")


QUERIES = {f.__name__: f for f in (streaming_latest_state, streaming_windows, streaming_running_count)}

SQL = {
    "streaming_latest_state": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "streaming_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
