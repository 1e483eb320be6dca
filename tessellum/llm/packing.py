"""Filling containers of fixed capacity with documents.

Every document is sized in tokens of a public vocabulary and projected: its hashed token
vector (each token id has a fixed random direction) is averaged into three dimensions, which
are cut into levels and numbered along a Hilbert curve.  Documents are range-sorted by that
number, so neighbours are alike, and each stretch of the curve is packed on its own.  A
container takes the first document that waits on the curve and looks ahead along the curve
just as far as it must until some of the documents seen fill it exactly (sums of sizes are
the bits of an integer); after ``AHEAD`` documents the fullest choice is taken.  So a
container holds near neighbours of the curve.  Only (id, size, key) travels; texts never
leave the scan.

Defined results
---------------
* A document larger than the capacity is cut into pieces of the capacity and a rest; no
  other document is split.  Piece ``k`` starts at its token ``k * capacity``.
* Null and empty texts have size 0 and take a place in a container without filling it.
* Every row is packed, repeated ids and texts too; an empty table gives no containers.
* ``container_id`` = stretch of the curve << 32 | number within it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import load, store_counting
from . import bpe

CAPACITY = 2048
DIMENSIONS, LEVEL_BITS = 3, 10
AHEAD = 256  # documents looked at for one container, at most
STRETCH, LEAST_STRETCH = 50_000, 5_000  # documents packed by one task, about; cores are used down to the second
OUT = "container_id bigint, position int, doc_id bigint, piece int, n_tokens int, start_in_container int"


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Distances along the Hilbert curve of integer points (n, dimensions) below ``2**bits`` (Skilling's transform)."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    index = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


@lru_cache(1)
def _directions(n: int = 1 << 16) -> np.ndarray:
    """A fixed random direction for each hashed token id."""
    return np.random.default_rng(20240601).standard_normal((n, DIMENSIONS)).astype(np.float32)


def projections(ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """(texts, DIMENSIONS): the mean direction of each text's tokens."""
    table = _directions()
    sums = np.zeros((len(per_text) + 1, DIMENSIONS))
    filled = np.flatnonzero(per_text)
    if len(filled):
        begins = np.r_[0, np.cumsum(per_text[filled])[:-1]]
        sums[filled] = np.add.reduceat(table[ids & (len(table) - 1)], begins, axis=0)
    return sums[:-1] / np.maximum(per_text, 1)[:, None]


def curve_keys(means: np.ndarray) -> np.ndarray:
    level = (np.arctan(means * 6) / np.pi + 0.5) * (1 << LEVEL_BITS)
    return hilbert_index(np.clip(level.astype(np.int64), 0, (1 << LEVEL_BITS) - 1), LEVEL_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, curve, place): ``place`` is the projection."""
    path = path or bpe.default_path()
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, per_text, _ in bpe.encode_column(batch.column("text"), path):
                means = projections(ids, per_text)
                place = pa.ListArray.from_arrays(pa.array(np.arange(0, means.size + 1, DIMENSIONS, np.int32)), pa.array(means.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(per_text), pa.array(curve_keys(means)), place], names=["doc_id", "n_tokens", "curve", "place"])

    return picked.mapInArrow(work, "doc_id bigint, n_tokens bigint, curve bigint, place array<double>")


def _fill(sizes: list[int], capacity: int) -> tuple[list[int], bool]:
    """(indices of the items for one container, whether it is full): the first item and some of those behind it, looking ahead as little as an exact fill allows."""
    room = capacity - sizes[0]
    if not room:
        return [0], True
    sums, before, cut = 1, [], (1 << room + 1) - 1  # bit k: k tokens more can be taken
    for size in sizes[1:]:
        before.append(sums)
        if size <= room:
            sums |= sums << size & cut
            if sums >> room:
                break
    target = sums.bit_length() - 1
    full, chosen = target == room, []
    for k in range(len(before) - 1, -1, -1):
        if not sizes[k + 1] or not before[k] >> target & 1:  # empty texts seen on the way come along
            chosen.append(k + 1)
            target -= sizes[k + 1]
    return [0, *chosen[::-1]], full


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers of the documents of ``sized``."""
    spark = sizes.sparkSession
    rows = sizes.select("doc_id", "n_tokens", "curve")
    path, n = store_counting(rows, "sizes", all="true")
    stretches = max(1, -(-n["all"] // STRETCH), min(spark.sparkContext.defaultParallelism, n["all"] // LEAST_STRETCH))
    lined = load(spark, path, rows).withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(stretches, "curve", "tie").sortWithinPartitions("curve", "tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        sizes_, docs, pieces = [], [], []  # waiting items in order of the curve
        rows: list[tuple] = []

        def close(chosen: list[int]) -> None:
            nonlocal made
            start = 0
            for nth, k in enumerate(chosen):
                rows.append((base | made, nth, docs[k], pieces[k], sizes_[k], start))
                start += sizes_[k]
            made += 1
            for k in reversed(chosen):
                del sizes_[k], docs[k], pieces[k]

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in OUT.split(", ")])
                rows.clear()

        for batch in batches:
            for size, doc in zip(batch.column("n_tokens").to_pylist(), batch.column("doc_id").to_pylist()):
                whole, rest = divmod(size, capacity)
                for piece in range(whole):
                    rows.append((base | made, 0, doc, piece, capacity, 0))
                    made += 1
                if rest or not whole:
                    sizes_.append(rest)
                    docs.append(doc)
                    pieces.append(whole)
                while len(sizes_) > AHEAD:
                    close(_fill(sizes_[: AHEAD + 1], capacity)[0])
            yield from out()
        while sizes_:
            close(_fill(sizes_, capacity)[0])
        yield from out()

    return lined.mapInArrow(work, OUT)


def report(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_documents, fill (share of the space used) and alike.

    ``alike``: mean squared distance of the documents' projections from their container's mean,
    over that from the mean of all; 1 would be a choice without regard to the curve.  Documents
    without tokens and containers of one document do not count for it.
    """
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    space = boxes.agg(F.count("*").alias("n_containers"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"))
    axes = range(DIMENSIONS)
    at = packed.where("piece = 0 AND n_tokens > 0").select("container_id", "doc_id").join(sizes.select("doc_id", *[F.col("place")[i].alias(f"x{i}") for i in axes]), "doc_id")
    spread = lambda: sum((F.var_pop(f"x{i}") for i in axes), F.lit(0.0))
    inside = at.groupBy("container_id").agg(F.count("*").alias("n"), spread().alias("v")).where("n > 1").agg((F.sum(F.col("v") * F.col("n")) / F.sum(F.col("n") - 1)).alias("within"))
    whole = at.agg(spread().alias("v"))
    n = sizes.agg(F.count("*").alias("n_documents"))
    return space.crossJoin(n).crossJoin(inside).crossJoin(whole).select("n_containers", "n_documents", F.round("fill", 6).alias("fill"), F.round(F.col("within") / F.col("v"), 6).alias("alike"))  # one row each
