"""Duplicate detection by set overlap, random projections, and the tables made from it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .components import connected_components


def similar_sets(sets: DataFrame, id_col: str, items: str, threshold: float) -> DataFrame:
    """(a, b, similarity) with a < b and overlap above ``threshold``, exactly.

    Prefix filter: with its members ordered rarest first, a set shares one of its first
    ``n - ceil(t n) + 1`` members with any set that overlaps enough.  Equal sets must be made
    one before (see ``class_sets``), so frequent members stay out of the prefixes.  Sets travel
    as numbers and members as hashes; equal hashes only add candidates.
    """
    rows = materialize(sets.select(F.col(id_col).alias("id"), F.col(items).alias("set")).where(F.size("set") > 0).withColumn("no", F.monotonically_increasing_id()), "sets")
    member = rows.select("no", F.explode(F.transform("set", lambda x: F.xxhash64(x))).alias("m"))
    df = member.groupBy("m").agg(F.count("*").alias("df"))
    ordered = member.join(df, "m").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("df", "m"))).alias("o"))
    n = F.size("o")
    prefix = ordered.select("no", n.alias("n"), F.explode(F.slice("o", 1, n - F.ceil(threshold * n).cast("int") + 1)).alias("p")).select("no", "n", F.col("p.m").alias("m"))
    prefix = materialize(prefix, "prefixes")  # joined with itself
    a, b = prefix.select(F.col("no").alias("x"), F.col("n").alias("nx"), "m"), prefix.select(F.col("no").alias("y"), F.col("n").alias("ny"), "m")
    near = a.join(b, "m").where((F.col("x") < F.col("y")) & (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny"))).select("x", "y").distinct()
    left, right = rows.select(F.col("no").alias("x"), F.col("id").alias("ix"), F.col("set").alias("sx")), rows.select(F.col("no").alias("y"), F.col("id").alias("iy"), F.col("set").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    sim = both / (F.size("sx") + F.size("sy") - both)
    return near.join(left, "x").join(right, "y").select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b"), sim.alias("similarity")).where(F.col("similarity") > threshold)


def keyed_sets(sets: DataFrame, id_col: str, items: str) -> DataFrame:
    """(id, set, k), stored: ``k`` is equal for equal sets."""
    return materialize(sets.select(F.col(id_col).alias("id"), F.col(items).alias("set"), F.sha2(F.array_join(F.array_sort(items), "\u0001"), 256).alias("k")), "keyed")


def duplicate_classes(keyed: DataFrame) -> DataFrame:
    """(id, class_id) of ``keyed_sets``: equal sets share the smallest id."""
    names = keyed.groupBy("k").agg(F.min("id").alias("class_id"))
    return keyed.select("id", "k").join(names, "k").select("id", "class_id")


def class_sets(keyed: DataFrame) -> DataFrame:
    """(id, set): the smallest id of each class with its set."""
    return keyed.join(keyed.groupBy("k").agg(F.min("id").alias("id")).select("id"), "id", "left_semi").select("id", "set")


def member_pairs(pairs: DataFrame, keyed: DataFrame, block: int = 256) -> DataFrame:
    """(a, b, similarity) with a < b: every two ids of ``keyed_sets`` that are of one class (similarity 1) or of two linked by ``pairs`` (a, b, similarity).

    Members of a class lie in blocks, and a row of the last shuffle is two blocks, so a class of many copies is spread over tasks.
    """
    classes = duplicate_classes(keyed)
    parts = classes.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    placed = classes.join(parts, "class_id").select("class_id", "n", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    blocks = materialize(placed.groupBy("class_id", "part").agg(F.collect_list("id").alias("ids"), F.max("n").alias("n")), "blocks")
    within = blocks.where("n > 1").select(F.col("class_id").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity"))
    side = lambda c: blocks.select(F.col("class_id").alias(c), F.col("part").alias(f"p{c}"), F.col("ids").alias(f"ids_{c}"))
    met = pairs.select("a", "b", "similarity").unionByName(within).join(side("a"), "a").join(side("b"), "b").where("a <> b OR pa <= pb")
    spread = met.repartition("a", "pa", "b", "pb").select("similarity", (F.expr("a = b AND pa = pb")).alias("same"), F.explode("ids_a").alias("x"), "ids_b").select("similarity", "same", "x", F.explode("ids_b").alias("y"))
    return spread.where("NOT same OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def rewrite_table(pairs: DataFrame, classes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(id, canonical): every id of a class or of linked classes to the smallest id of the component.

    With the table of an earlier run (``previous``: id, canonical) a component that has one of its
    ids keeps that id's canonical one (the smallest, if there are several).
    """
    edges = pairs.select("a", "b").unionByName(classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b")))
    parts = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("canonical"))
    if previous is None:
        return parts
    known = parts.join(previous.select("id", F.col("canonical").alias("old")), "id").groupBy("canonical").agg(F.min("old").alias("old"))
    return parts.join(known, "canonical", "left").select("id", F.coalesce("old", "canonical").alias("canonical"))


SIGNATURE_BITS = 1024


def signature(items: Column) -> Column:
    """A set's Bloom signature: 16 words of 64 bits, one bit of 1024 set for each member (by MD5)."""
    bits = F.transform(items, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint") % SIGNATURE_BITS)

    def words(at: Column) -> Column:
        one = lambda w: F.aggregate(F.filter(at, lambda b: F.floor(b / 64) == w), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % 64).cast("int"))))
        return F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE_BITS // 64 - 1)), one)

    return F.element_at(F.transform(F.array(bits), words), 1)


def bits_set(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def signature_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(bits of both / bits of either, bits of both / bits of ``a``): the likeness of two signatures and its bound for what lies below ``a``; 0 without bits."""
    both = bits_set(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = bits_set(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either > 0, both / either).otherwise(0.0), F.when(bits_set(a) > 0, both / bits_set(a)).otherwise(0.0)


def gaussian_planes(n: int, dimensions: int, seed: int = 11) -> np.ndarray:
    """(n, dimensions) normals of random planes, the same for the same seed."""
    return np.random.default_rng(seed).standard_normal((n, dimensions))


def projection_buckets(vectors: DataFrame, id_col: str, vector: str, planes: np.ndarray, tables: int = 1) -> DataFrame:
    """(id, table_no, bucket): on which side of each plane a centred vector lies; the planes are dealt to the tables in order.

    The centre is the mean of all vectors (one row). Null vectors, or those of another length, are in no bucket.
    """
    bits = len(planes) // tables
    if not 1 <= bits <= 62:
        raise ValueError(f"{len(planes)} planes do not give {tables} tables 1 to 62 bits each")
    n = planes.shape[1]
    fit = vectors.where(F.size(vector) == n).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    centre = fit.agg(*[F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(n)]).first()
    offset = np.zeros(len(planes)) if centre["c0"] is None else planes @ np.array(list(centre))
    shared = vectors.sparkSession.sparkContext.broadcast((planes.T.copy(), offset))

    @F.arrow_udf("array<bigint>")
    def sides(v: pa.Array) -> pa.Array:
        normal, at = shared.value
        x = np.asarray(v.flatten()).reshape(len(v), n)
        keys = ((x @ normal > at).reshape(len(x), tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, np.int32)), pa.array(keys.ravel()))

    return fit.select("id", F.posexplode(sides("v")).alias("table_no", "bucket"))


def tables_for(threshold: float, bits: int, miss: float = 5e-4) -> int:
    """Tables until two vectors at the cosine ``threshold`` share no bucket with at most the chance ``miss``."""
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - alike)) if alike < 1 else 1


def similar_vectors(left: DataFrame, right: DataFrame, id_col: str, vector: str, threshold: float, bits: int = 10) -> DataFrame:
    """(a, b, similarity): vectors of both sides with a cosine of at least ``threshold``.

    Pairs that share a bucket of one of the tables (see ``tables_for``) are compared exactly; so
    nothing wrong comes out and a pair right at the threshold is missed with a chance of 0.05 %.
    """
    rows = materialize(left.select(F.lit("a").alias("side"), F.col(id_col).alias("id"), F.col(vector).alias("v")).unionByName(right.select(F.lit("b").alias("side"), F.col(id_col).alias("id"), F.col(vector).alias("v"))).where("v IS NOT NULL"), "vectors")
    first = rows.select(F.size("v").alias("n")).limit(1).collect()
    tables = tables_for(threshold, bits)
    planes = gaussian_planes(tables * bits, first[0]["n"] if first else 1)
    met = projection_buckets(rows.select(F.struct("side", "id").alias("key"), "v"), "key", "v", planes, tables).select("id.side", "id.id", "table_no", "bucket")
    side = lambda x: met.where(F.col("side") == x).select(F.col("id").alias(x), "table_no", "bucket")
    pairs = side("a").join(side("b"), ["table_no", "bucket"]).select("a", "b").distinct()
    full = lambda x: rows.where(F.col("side") == x).select(F.col("id").alias(x), F.col("v").cast("array<double>").alias(f"v{x}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    return pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", cosine.alias("similarity")).where(F.col("similarity") >= threshold)


def all_pairs_above(sets: DataFrame, id_col: str, items: str, threshold: float, most: int = 5_000) -> DataFrame:
    """(a, b, similarity) by comparing every pair: the yardstick for ``similar_sets`` on small tables; more than ``most`` rows are refused."""
    n = sets.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} sets are not compared pair by pair")
    a, b = sets.select(F.col(id_col).alias("a"), F.col(items).alias("sa")), sets.select(F.col(id_col).alias("b"), F.col(items).alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    return pairs.where(F.col("similarity") > threshold)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
