"""References to records that do not exist.

Keys are cut into ranges.  The parents of a range travel to one task, which keeps them as
sorted arrays and probes arriving reference batches by binary search; references stream, so
memory is bounded by the parents of one range.  Ranges that draw many references (a hot key
may draw a third of all) are salted: their references spread over several tasks, each of
which gets a copy of that range's parents.  The range bounds come from a sample of parent
keys and only steer balance, never results.

Defined results
---------------
* A null reference is none.  Exactly repeated reference rows count once.
* A parent key delivered several times has its earliest ``loaded_at`` and earliest non-null
  ``deleted_at``; parents with a null key are none.
* ``missing``: no parent row has the key; else ``deleted``: ``deleted_at`` is at or before
  the reference's ``loaded_at``; else ``late``: the parent's earliest ``loaded_at`` is after
  the reference's.  A reference with null ``loaded_at`` can only be ``missing``.
* Keys are compared as stored.  String keys longer than 64 bytes are compared by SHA-512.
* Empty tables give no rows (no parents: every reference is missing).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import load, store_counting

RANGE_KEYS = 500_000  # parents of one range at most, about
SALT_ROWS = 100_000  # references of one task at most, about
SAMPLE_PER_RANGE = 60
KEY_BYTES = 64
OUT = "table_name string, field_name string, row_id bigint, loaded_at timestamp, reason string"
REASONS = pa.array(["", "missing", "deleted", "late"])


def _key(col: Column, text: bool) -> Column:
    if not text:
        return col.cast("bigint")
    # the closing mark keeps trailing NULs apart in fixed-width arrays
    raw = F.encode(col, "UTF-8")
    short = F.concat(raw, F.lit(b"."))
    return F.when(F.octet_length(col) <= KEY_BYTES, short).otherwise(F.encode(F.concat(F.lit("#"), F.substring(F.sha2(raw, 512), 1, KEY_BYTES)), "UTF-8"))


def _as_array(col: pa.Array | pa.ChunkedArray, text: bool) -> np.ndarray:
    """Keys as a NumPy array: integers, or byte strings of fixed width straight from Arrow's buffers."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not text:
        return col.to_numpy(zero_copy_only=False).astype(np.int64)
    width, n = KEY_BYTES + 1, len(col)
    if not n:
        return np.empty(0, f"S{width}")
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    out = np.zeros((n, width), np.uint8)
    if (size == size[0]).all():
        out[:, : size[0]] = flat.reshape(n, size[0])
    else:
        out.ravel()[np.repeat(np.arange(n) * width - (at[:-1] - at[0]), size) + np.arange(len(flat))] = flat
    return out.view(f"S{width}").ravel()


def _micros(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    valid = np.asarray(col.is_valid())
    return col.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), valid


def parent_keys(parents: DataFrame, key_col: str, text: bool) -> DataFrame:
    rows = parents.select(_key(F.col(key_col), text).alias("key"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("first"), F.unix_micros(F.col("deleted_at").cast("timestamp")).alias("gone"))
    return rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("first").alias("first"), F.min("gone").alias("gone"))


def reference_rows(rows: DataFrame, table: str, field: str, id_col: str, text: bool) -> DataFrame:
    picked = rows.where(F.col(field).isNotNull()).select(F.lit(f"{table}.{field}").alias("source"), F.col(id_col).cast("bigint").alias("row_id"), _key(F.col(field), text).alias("key"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"))
    return picked.distinct()


def find_orphans(references: DataFrame, parents: DataFrame, text: bool) -> DataFrame:
    """Misses of ``references`` (see ``reference_rows``) among ``parents`` (see ``parent_keys``)."""
    spark = references.sparkSession
    path, n = store_counting(parents, "parents", all="true")
    parents, n_parents = load(spark, path, parents), n["all"]
    path, n = store_counting(references, "references", all="true")
    references = load(spark, path, references)
    n_ranges = max(1, -(-n_parents // RANGE_KEYS), min(-(-n["all"] // SALT_ROWS), n_parents), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_parents // 1000))
    share = min(1.0, n_ranges * SAMPLE_PER_RANGE / max(1, n_parents))
    sample = parents.select("key") if share == 1.0 else parents.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key")
    keys = np.sort(_as_array(sample.toArrow()["key"], text))
    bounds = keys[(np.arange(1, n_ranges) * len(keys)) // n_ranges] if len(keys) else keys
    shared = spark.sparkContext.broadcast(bounds)  # one key a range

    @F.arrow_udf(T.IntegerType())
    def range_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, _as_array(key, text), side="right").astype(np.int32))

    references = references.withColumn("rng", range_of("key"))
    counts = references.groupBy("rng").agg(F.count("*").alias("n")).toArrow()  # one row a range
    parts = np.ones(n_ranges, np.int64)
    parts[counts["rng"].to_numpy()] = -(-counts["n"].to_numpy() // SALT_ROWS)
    parts = np.maximum(parts, 1)
    cells = spark.sparkContext.broadcast((np.cumsum(parts) - parts, parts))  # two numbers a range

    def of_range(which: int) -> Callable:
        @F.arrow_udf(T.IntegerType())
        def look_up(rng: pa.Array) -> pa.Array:
            return pa.array(cells.value[which][rng.to_numpy(zero_copy_only=False)].astype(np.int32))

        return look_up

    first, salts = of_range(0), of_range(1)
    refs = references.select((first("rng") + F.pmod(F.xxhash64("row_id"), salts("rng"))).cast("int").alias("cell"), F.lit(1).alias("tag"), "key", F.col("at").alias("a"), F.lit(None).cast("bigint").alias("b"), "source", "row_id")
    held = parents.withColumn("rng", range_of("key")).select("key", "first", "gone", first("rng").alias("c0"), salts("rng").alias("salts"))
    held = held.select(F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("salts") - 1)).alias("cell"), F.lit(0).alias("tag"), "key", F.col("first").alias("a"), F.col("gone").alias("b"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("row_id"))
    mixed = held.unionByName(refs).repartitionById(int(parts.sum()), "cell").sortWithinPartitions("cell", "tag")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, index = None, [], None
        for batch in batches:
            group = batch.column("cell").to_numpy(zero_copy_only=False)
            tag = batch.column("tag").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(tag) != 0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(group)]):
                if group[lo] != at:
                    at, parts, index = group[lo], [], None
                piece = batch.slice(lo, hi - lo)
                if tag[lo] == 0:
                    parts.append(piece)
                    continue
                if index is None:
                    index = _sorted_parents(parts, text)
                    parts = []
                yield from _misses(piece, index, text)

    return mixed.mapInArrow(probe, OUT)


def _sorted_parents(parts: list[pa.RecordBatch], text: bool) -> tuple:
    if not parts:
        return (_as_array(pa.array([], pa.binary() if text else pa.int64()), text),) + (np.empty(0, np.int64), np.empty(0, bool)) * 2
    table = pa.Table.from_batches(parts)
    keys = _as_array(table["key"], text)
    order = np.argsort(keys, kind="stable")
    first, has_first = _micros(table["a"])
    gone, has_gone = _micros(table["b"])
    return keys[order], first[order], has_first[order], gone[order], has_gone[order]


def _misses(piece: pa.RecordBatch, index: tuple, text: bool) -> Iterator[pa.RecordBatch]:
    keys, first, has_first, gone, has_gone = index
    probe = _as_array(piece.column("key"), text)
    at, has_at = _micros(piece.column("a"))
    if len(keys):
        pos = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
        found = keys[pos] == probe
        deleted = found & has_at & has_gone[pos] & (gone[pos] <= at)
        late = found & has_at & has_first[pos] & (first[pos] > at) & ~deleted
    else:
        found = deleted = late = np.zeros(len(probe), bool)
    reason = np.where(~found, 1, np.where(deleted, 2, np.where(late, 3, 0)))
    keep = np.flatnonzero(reason)
    if not len(keep):
        return
    rows = piece.take(pa.array(keep))
    names = [s.split(".", 1) for s in rows.column("source").to_pylist()]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([n[0] for n in names], pa.string()),
            pa.array([n[1] for n in names], pa.string()),
            rows.column("row_id"),
            rows.column("a").cast(pa.timestamp("us")).cast(pa.timestamp("us", tz="UTC")),
            REASONS.take(pa.array(reason[keep])),
        ],
        names=["table_name", "field_name", "row_id", "loaded_at", "reason"],
    )
