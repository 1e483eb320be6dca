"""Near-duplicate records with small edits, by anchor points.

A text's fingerprint is a word of four min-hash symbols a block over its set of neighbouring
word pairs: two fingerprints agree in a position with the probability of the sets' overlap
(Jaccard).  The anchors are the words of a covering code: per block all words with three
symbols given and one free.  Every block word lies within distance 1 (the covering radius) of
exactly four anchors, and two block words at distance 1 or less share one.  By the pigeonhole
principle fingerprints that differ in at most ``2 * blocks - 1`` of the ``4 * blocks`` symbols
have a block at distance 1 or less, hence meet at an anchor; others meet with a probability
that falls with their distance.  The number of blocks follows from the threshold, so that a
pair right at it fails to meet with a probability of at most ``MISS`` (at 0.5: 20 blocks).

Every fingerprint is replicated to its anchors and compared per anchor.  Pairs that meet pass
a sieve (agreement of 64 short symbols, missed with at most ``MISS`` / 4 at the threshold),
then their sets are compared exactly.  Texts with equal sets are one class and travel once.
All word pairs count, however common.  Anchors met by more than ``LONG_RUN`` classes are
compared in square blocks spread over tasks.

Defined results
---------------
* Words are maximal runs of Unicode letters and digits of the lower-cased text.  Null texts,
  null ids and texts of fewer than two words are in no pair.
* A repeated id is one record; if its rows differ in content, each content counts.
* ``id_a < id_b``; each pair once.  Between two classes (and within one) all pairs of ids come
  out while their number is at most ``MOST_COPIES``, or always with ``all_pairs``.  Beyond,
  every id is linked with its class's smallest id and the smallest ids with each other, which
  names the same classes and links; ``Found`` has them as classes and members.
* Thresholds from 0.2 to 1 are allowed.  Extra columns are ignored; an empty table gives no pairs.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import load, materialize, scope, store_counting
from .textbatch import Joined, SliceHasher, blocks

MISS = 6e-4  # chance that a pair right at the threshold does not meet
SKETCH = 64  # symbols of the sieves
LONG_RUN = 256
SQUARE = 1024
PART_ANCHORS = 2_000_000  # anchors compared at once, about
MOST_COPIES = 1_000_000
FILTER_BITS = 1 << 26  # of the filter that goes to the scan, at most
_ODD = np.random.default_rng(7).integers(1, 2**63, (2048, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Code:
    """What follows from a threshold."""

    threshold: float
    blocks: int
    least_nibbles: int  # agreeing symbols of 4 bits, of SKETCH
    least_bytes: int  # agreeing symbols of 8 bits, of SKETCH

    @property
    def symbols(self) -> int:
        return 4 * self.blocks


def code_for(threshold: float) -> Code:
    if not 0.2 <= threshold <= 1:
        raise ValueError(f"threshold {threshold} is outside 0.2 .. 1")
    t = threshold
    meets = 4 * t**3 * (1 - t) + t**4
    n = max(SKETCH // 4, math.ceil(math.log(MISS) / math.log(1 - meets))) if meets < 1 else SKETCH // 4

    def least(bits: int) -> int:
        agree, below = t + (1 - t) / 2**bits, 0.0
        for k in range(SKETCH + 1):
            below += math.comb(SKETCH, k) * agree**k * (1 - agree) ** (SKETCH - k)
            if below > MISS / 4:
                return k
        return SKETCH

    return Code(threshold, n, least(4), least(8))


@lru_cache(1)
def _word_points() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[p for p in range(0x110000) if chr(p).isalnum()]] = True
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct neighbouring word pairs, their number for each text), sorted within a text."""
    batch = Joined(pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.string()))
    word = _word_points()[batch.points]
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(batch.stop, start)
    h = SliceHasher(batch.points).of(start, stop)
    same = owner[1:] == owner[:-1]
    pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(h[1:]))[same]
    own = owner[1:][same]
    order = np.lexsort((pair, own))
    pair, own = pair[order], own[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])
    return pair[new], np.bincount(own[new], minlength=len(texts)).astype(np.int64)


def _minima(pairs: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) symbols: low halves of the smallest 32-bit values; texts without pairs must not be given."""
    begins = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), n), np.uint16)
    for k in range(n):
        a, b = _ODD[k]
        out[:, k] = np.minimum.reduceat(((pairs * a + b) >> np.uint64(32)).astype(np.uint32), begins) & np.uint32(0xFFFF)
    return out


def _anchor_keys(symbols: np.ndarray) -> np.ndarray:
    """(texts, symbols): the 48-bit anchor of each block that leaves one of its symbols free."""
    n = symbols.shape[1]
    keys = np.empty(symbols.shape, np.uint64)
    s = symbols.astype(np.uint64)
    for at in range(n):
        first = at - at % 4
        a, b, c = (j for j in range(first, first + 4) if j != at)
        keys[:, at] = _mix(((s[:, a] << np.uint64(32)) | (s[:, b] << np.uint64(16)) | s[:, c]) + np.uint64((at + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(16)
    return keys


def _records(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))


def _set_keys(pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.cumsum(sizes) - sizes
    sums = lambda x: np.add.reduceat(x, begins).view(np.int64)
    return sums(_mix(pairs + np.uint64(1))), sums(_mix(pairs * np.uint64(3) + np.uint64(5)))


def fingerprints(records: DataFrame, code: Code) -> DataFrame:
    """(id, k1, k2, print, q0..q3): set key, fingerprint of the set, and its 64 symbols of 4 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in blocks(batch.column("text")):
                pairs, sizes = word_pairs(batch.column("text").slice(lo, hi - lo))
                have = np.flatnonzero(sizes)
                if not len(have):
                    continue
                k1, k2 = _set_keys(pairs, sizes[have])
                symbols = _minima(pairs, sizes[have], code.symbols)
                nibbles = (symbols[:, :SKETCH] & np.uint16(15)).astype(np.uint8)
                quads = np.ascontiguousarray(nibbles[:, 0::2] | (nibbles[:, 1::2] << 4)).view(np.int64)
                size = symbols.shape[1] * 2
                prints = pa.Array.from_buffers(pa.binary(size), len(have), [None, pa.py_buffer(np.ascontiguousarray(symbols))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo).take(pa.array(have)), pa.array(k1), pa.array(k2), prints, *(pa.array(quads[:, i]) for i in range(4))],
                    names=["id", "k1", "k2", "print", "q0", "q1", "q2", "q3"],
                )

    return records.mapInArrow(work, "id string, k1 bigint, k2 bigint, print binary, q0 bigint, q1 bigint, q2 bigint, q3 bigint")


def _symbols(prints: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint16).reshape(len(prints), n)


# Anchors travel packed: a row holds those of one batch and one part of the anchors' range.
ENTRIES, MARKS, MEMBERS = range(3)


def _pack(kind: int, anchors: np.ndarray, cids: np.ndarray) -> bytes:
    """Sorted anchors as differences and classes as distances from the least, each in the fewest bytes."""
    base, first = int(cids.min()), int(anchors[0])
    gaps, places = np.diff(anchors), cids - base
    narrow = lambda x, kinds: next(i for i, k in enumerate(kinds) if not len(x) or int(x.max()) <= np.iinfo(k).max)
    g, p = narrow(gaps, _WIDTHS), narrow(places, _WIDTHS)
    return struct.pack("<BBBqq", kind, g, p, base, first) + gaps.astype(_WIDTHS[g]).tobytes() + places.astype(_WIDTHS[p]).tobytes()


_WIDTHS = (np.uint16, np.uint32, np.uint64)


def _unpack(blob: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    kind, g, p, base, first = struct.unpack_from("<BBBqq", blob)
    wide, head = np.dtype(_WIDTHS[g]).itemsize, struct.calcsize("<BBBqq")
    n = (len(blob) - head + wide) // (wide + np.dtype(_WIDTHS[p]).itemsize)
    gaps = np.frombuffer(blob, _WIDTHS[g], n - 1, head).astype(np.uint64)
    places = np.frombuffer(blob, _WIDTHS[p], n, head + (n - 1) * wide)
    return kind, np.cumsum(np.r_[np.uint64(first), gaps]), places.astype(np.int64) + base


def _run_pairs(anchors: np.ndarray, cids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within runs of equal anchors."""
    at, span = np.arange(len(anchors)), 1
    out_a, out_b = [], []
    while True:
        at = at[at + span < len(anchors)]
        at = at[anchors[at] == anchors[at + span]]
        if not len(at):
            break
        out_a.append(cids[at])
        out_b.append(cids[at + span])
        span += 1
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def _meet(classes: DataFrame, n_classes: int, code: Code) -> DataFrame:
    """(a, b, anchor): pairs of classes at an anchor, or (a, null, anchor) for members of long runs.

    A batch sends each part of the anchors' range one packed row.  Members of an anchor that is
    long within the batch alone do not go to its part but come out at once; the part gets a mark.
    So a part holds at most ``LONG_RUN`` members of an anchor from each batch.
    """
    spark = classes.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, -(-n_classes * code.symbols // PART_ANCHORS))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            symbols = _symbols(batch.column("print"), code.symbols)
            cuts = np.flatnonzero(np.diff(cid >> 33)) + 1  # numbers of one writing task are near each other
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(cid)]):
                if hi > lo:
                    yield packed(symbols[lo:hi], cid[lo:hi])

    def packed(symbols: np.ndarray, cid: np.ndarray) -> pa.RecordBatch:
        keys = _anchor_keys(symbols).ravel()
        order = np.argsort(keys, kind="stable")
        keys, cids = keys[order], np.repeat(cid, code.symbols)[order]
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[begins, len(keys)])
        place = (keys >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)
        to, blobs = [], []
        long_ = size > LONG_RUN
        if long_.any():
            for b, n in zip(begins[long_], size[long_]):
                to += [int(place[b]), int(cids[b]) % parts]
                blobs += [_pack(MARKS, keys[b : b + 1], cids[b : b + 1]), _pack(MEMBERS, keys[b : b + n], cids[b : b + n])]
            fine = ~np.repeat(long_, size)
            keys, cids, place = keys[fine], cids[fine], place[fine]
        cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if hi > lo:
                to.append(int(place[lo]))
                blobs.append(_pack(ENTRIES, keys[lo:hi], cids[lo:hi]))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries, marks = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not entries:
                return
            keys, cids = (np.concatenate(x) for x in zip(*entries))
            order = np.argsort(keys, kind="stable")
            keys, cids = keys[order], cids[order]
            begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[begins, len(keys)])
            long_ = size > LONG_RUN
            if marks:
                long_ |= np.isin(keys[begins], np.concatenate(marks))
            several = np.repeat((size > 1) & ~long_, size)
            a, b = _run_pairs(keys[several], cids[several])
            if len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                yield _pairs(a[new], b[new], np.zeros(int(new.sum()), np.int64))
            if long_.any():
                hot = np.repeat(long_, size)
                yield _pairs(cids[hot], None, keys[hot].view(np.int64))

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                if part != at:
                    yield from close()
                    at, entries, marks = part, [], []
                kind, keys, cids = _unpack(blob)
                if kind == ENTRIES:
                    entries.append((keys, cids))
                elif kind == MARKS:
                    marks.append(keys)
                else:
                    yield _pairs(cids, None, keys.view(np.int64))
        yield from close()

    spread = classes.select("cid", "print").mapInArrow(replicate, "part bigint, blob binary")
    return spread.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(compare, "a bigint, b bigint, anchor bigint")


def _pairs(a: np.ndarray, b: np.ndarray | None, anchor: np.ndarray) -> pa.RecordBatch:
    second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), second, pa.array(anchor, pa.int64())], names=["a", "b", "anchor"])


def _long_runs(members: DataFrame, classes: DataFrame, code: Code) -> DataFrame:
    """Candidate pairs (a, b) among the members (anchor, a) of long runs, compared in squares of SQUARE classes."""
    runs = members.groupBy("anchor").agg((F.floor((F.count("*") - 1) / SQUARE) + 1).cast("int").alias("parts"))
    placed = members.join(runs, "anchor").withColumn("own", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tasks = placed.select("anchor", "a", "own", to).select("anchor", "a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    rows = tasks.join(classes.select("cid", "print"), F.col("a") == F.col("cid")).select("anchor", "i", "j", "own", "a", "print")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            own, cid = t["own"].to_numpy(), t["a"].to_numpy()
            s = (_symbols(t["print"].combine_chunks(), code.symbols)[:, :SKETCH] & np.uint16(255)).astype(np.uint8)
            li, ri = np.flatnonzero(own == at[1]), np.flatnonzero(own == at[2])
            for lo in range(0, len(li), 128):
                agree = np.zeros((len(li[lo : lo + 128]), len(ri)), np.uint8)
                for c in range(SKETCH):
                    agree += s[li[lo : lo + 128], c][:, None] == s[ri, c][None, :]
                x, y = np.nonzero(agree >= code.least_bytes)
                a, b = cid[li[lo + x]], cid[ri[y]]
                fine = a < b if at[1] == at[2] else a != b
                yield _pairs(np.minimum(a, b)[fine], np.maximum(a, b)[fine], np.full(int(fine.sum()), at[0], np.int64))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            k = np.stack([t["anchor"].to_numpy(), t["i"].to_numpy(), t["j"].to_numpy()], axis=1)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(k)]):
                key = tuple(int(v) for v in k[lo])
                if key != at:
                    if held:
                        yield from close()
                    at, held = key, []
                held.append(t.slice(lo, hi - lo))
        if held:
            yield from close()

    return rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(squares, "a bigint, b bigint, anchor bigint").select("a", "b")


def _alike(code: Code) -> Column:
    """Whether at least ``least_nibbles`` of the 64 symbols of 4 bits in q0..q3 and r0..r3 agree."""
    differ = F.lit(0)
    for i in range(4):
        x = F.col(f"q{i}").bitwiseXOR(F.col(f"r{i}"))
        low = x
        for k in (1, 2, 3):
            low = low.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(low.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= SKETCH - code.least_nibbles


def _sets(records: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(cid, pairs) of the ``wanted`` classes (cid, rep, c1, c2): the sets of their smallest ids' texts.

    A bit filter of the wanted ids, of bounded size, goes to the scan, so few texts are cut into
    words and only sets travel; a full filter lets more through and changes nothing else.
    """
    spark = records.sparkSession
    bits = min(FILTER_BITS, 1 << max(10, (16 * n_wanted).bit_length()))
    marked = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(bits)).alias("bit"))

    def collect_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column("bit").to_numpy()
            np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        word = np.flatnonzero(own.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(own.view(np.int64)[word])], names=["at", "word"])

    words = marked.mapInArrow(collect_bits, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # at most FILTER_BITS / 64 rows
    field = np.zeros(bits // 64, np.int64)
    field[words["at"].to_numpy()] = words["word"].to_numpy()
    shared = spark.sparkContext.broadcast(field.view(np.uint8))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((known[bit >> 3] >> (bit & 7)) & 1 == 1))
            for lo, hi in blocks(batch.column("text")):
                own, sizes = word_pairs(batch.column("text").slice(lo, hi - lo))
                have = np.flatnonzero(sizes)
                if not len(have):
                    continue
                k1, k2 = _set_keys(own, sizes[have])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[have])].astype(np.int32)), pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo).take(pa.array(have)), pa.array(k1), pa.array(k2), lists], names=["id", "k1", "k2", "pairs"])

    rows = records.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(bits))).mapInArrow(work, "id string, k1 bigint, k2 bigint, pairs array<bigint>")
    # an id may come with other contents
    same = (F.col("id") == F.col("rep")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    return rows.join(wanted, same).select("cid", "pairs").dropDuplicates(["cid"])


class Found:
    """``members``: id, cid of the classes with several rows or a link; ``links``: a, b (classes of overlap at least the threshold)."""

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links


def near_duplicates(rows: DataFrame, id_col: str = "id", text_col: str = "content", threshold: float = 0.5) -> Found:
    spark, code = rows.sparkSession, code_for(threshold)
    records = _records(rows, id_col, text_col)
    with scope(spark) as keep:
        prints = materialize(fingerprints(records, code), "prints")
        one = prints.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("print", "q0", "q1", "q2", "q3")])
        one = one.withColumn("cid", F.monotonically_increasing_id())
        path, n = store_counting(one, "classes", all="true")
        classes = load(spark, path, one)
        met_rows = _meet(classes, n["all"], code)
        path, n = store_counting(met_rows, "met", long="b IS NULL")
        met = load(spark, path, met_rows)
        pairs = met.where("b IS NOT NULL").select("a", "b")
        if n["long"]:
            pairs = pairs.unionByName(_long_runs(met.where("b IS NULL").select("anchor", "a"), classes, code))
        quads = lambda c, p: classes.select(F.col("cid").alias(c), *[F.col(f"q{i}").alias(f"{p}{i}") for i in range(4)])
        pairs = materialize(pairs.distinct().join(quads("a", "q"), "a").join(quads("b", "r"), "b").where(_alike(code)).select("a", "b"), "candidates")
        involved = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted_rows = classes.join(involved, "cid", "left_semi").select("cid", "rep", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
        path, n = store_counting(wanted_rows, "wanted", all="true")
        grams = materialize(_sets(records, load(spark, path, wanted_rows), n["all"]), "sets")
        left = grams.select(F.col("cid").alias("a"), F.col("pairs").alias("pa"))
        right = grams.select(F.col("cid").alias("b"), F.col("pairs").alias("pb"))
        shared = F.size(F.array_intersect("pa", "pb"))
        checked = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("s"), (F.size("pa") + F.size("pb") - shared).alias("u"))
        links = keep(checked.where(F.col("s") >= threshold * F.col("u")).select("a", "b"), "links")
        linked = links.select(F.explode(F.array("a", "b")).alias("cid")).distinct().withColumn("linked", F.lit(True))
        told = classes.select("cid", "n", "k1", "k2").join(linked, "cid", "left").where("n > 1 OR linked").select("cid", "k1", "k2")
        members = keep(prints.select("id", "k1", "k2").join(told, ["k1", "k2"]).select("id", "cid").distinct(), "members")
    return Found(members, links)


def pairs_of_ids(found: Found, all_pairs: bool = False) -> DataFrame:
    """(id_a, id_b)."""
    members, links = found.members, found.links
    size = materialize(members.groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("rep")), "sizes")
    inside = size.where("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    sides = lambda c, p: size.select(F.col("cid").alias(c), F.col("n").alias(f"n{p}"), F.col("rep").alias(f"r{p}"))
    all_ = materialize(links.select("a", "b").unionByName(inside).join(sides("a", "a"), "a").join(sides("b", "b"), "b"), "class_links")
    few = F.lit(True) if all_pairs else F.col("na") * F.col("nb") <= MOST_COPIES
    small, big = all_.where(few), all_.where(~few)
    full = small.join(members.select(F.col("cid").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("cid").alias("b"), F.col("id").alias("y")), "b")
    full = full.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select("x", "y")
    ordered = lambda rows: rows.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    if all_pairs or not big.limit(1).count():
        return ordered(full.where("x <> y")).distinct()
    reps = big.where("a <> b").select(F.col("ra").alias("x"), F.col("rb").alias("y"))
    # the members of large classes, and of those linked with one, hang on their smallest id
    hang = members.join(big.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi").join(size, "cid").select(F.col("id").alias("x"), F.col("rep").alias("y"))
    return ordered(full.unionByName(reps).unionByName(hang).where("x <> y")).distinct()


def groups(found: Found) -> DataFrame:
    """(id, group_id, n_links): every record with a copy or near copy; the group is named by its smallest id, n_links counts linked classes."""
    members, links = found.members, found.links
    parts = connected_components(links).withColumnRenamed("node", "cid")
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid")
    named = members.join(parts, "cid", "left").join(degree, "cid", "left").join(copies.withColumn("copied", F.lit(True)), "cid", "left").where("component IS NOT NULL OR copied")
    named = named.select("id", F.coalesce("component", "cid").alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = named.groupBy("part").agg(F.min("id").alias("group_id"))
    return named.join(names, "part").select("id", "group_id", "n_links")


def classes_and_links(found: Found) -> DataFrame:
    """(id, class_id, linked_class): each record with its class of equal sets (named by its smallest id) and every class linked to that one; null without links."""
    names = found.members.groupBy("cid").agg(F.min("id").alias("class_id"))
    both = found.links.select("a", "b").unionByName(found.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ties = both.join(names.select(F.col("cid").alias("b"), F.col("class_id").alias("linked_class")), "b").select(F.col("a").alias("cid"), "linked_class")
    return found.members.join(names, "cid").join(ties, "cid", "left").select("id", "class_id", "linked_class").where("id <> class_id OR linked_class IS NOT NULL")
