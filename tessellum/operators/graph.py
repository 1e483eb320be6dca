"""Graph analytics over edge tables (src, dst[, weight]).

Iterations are joins and aggregations; every round is written, its sums are taken while it is
written, and the next round reads it back, so a plan holds one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, load, materialize, scope, store_counting, store_measuring

MOST_ATTRIBUTES = 100


def neighbour_pairs(docs: DataFrame, doc: str = "doc", node: str = "node") -> DataFrame:
    """(src, dst, weight): nodes that stand in the same document, once for each such document, both directions."""
    a, b = docs.select(F.col(doc).alias("d"), F.col(node).alias("src")), docs.select(F.col(doc).alias("d"), F.col(node).alias("dst"))
    return a.join(b, "d").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def pagerank(edges: DataFrame, iterations: int = 10, teleport: float = 0.15, jump: DataFrame | None = None, even: float = 0.0, tolerance: float | None = None, decimals: int = 9) -> DataFrame:
    """(node, score) of a weighted random walk; the walk's lost mass at dead ends returns by the jump.

    ``jump`` (node[, weight]): where the walk may start anew, in proportion to the weights; nodes
    outside the graph do not count, and without any inside the result is empty.  The share
    ``even`` of the jump goes to all nodes alike (1 without ``jump``).  ``tolerance`` ends the
    rounds when the scores' relative change (Euclidean) is no larger.
    """
    spark = edges.sparkSession
    with scope(spark) as keep:
        total = edges.groupBy("src").agg(F.sum(F.col("weight").cast("double")).alias("total"))
        shares = edges.join(total, "src").groupBy("src", "dst").agg((F.sum(F.col("weight").cast("double")) / F.max("total")).alias("share"))
        shares = materialize(shares, "shares")
        nodes = shares.select(F.col("src").alias("node"), F.lit(False).alias("sink")).union(shares.select("dst", F.lit(True))).groupBy("node").agg(F.min("sink").alias("sink"))
        if jump is None:
            given, even = nodes.withColumn("prior", F.lit(0.0)), 1.0
        else:
            prior = (jump if "weight" in jump.columns else jump.withColumn("weight", F.lit(1.0))).groupBy("node").agg(F.sum(F.col("weight").cast("double")).alias("prior"))
            given = nodes.join(prior, "node", "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
        path, m = store_measuring(given, "nodes", n=F.count(F.lit(1)), prior=F.sum("prior"))
        n, mass = m["n"], m["prior"] or 0.0
        if not n or (jump is not None and not mass):
            return nodes.limit(0).select("node", F.lit(0.0).alias("score"))
        to = F.lit(even / n) + (F.col("prior") * ((1 - even) / mass) if jump is not None else F.lit(0.0))
        start = load(spark, path, given).select("node", "sink", to.alias("jump"), to.alias("score"), F.lit(0.0).alias("change"))
        lost_mass = F.sum(F.when(F.col("sink"), F.col("score")).otherwise(0.0))
        path, m = store_measuring(start, "rank", lost=lost_mass)
        for _ in range(iterations):
            state = load(spark, path, start)
            flow = shares.join(state.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
            score = teleport * F.col("jump") + (1 - teleport) * (F.coalesce("flow", F.lit(0.0)) + F.lit(m["lost"]) * F.col("jump"))
            after = state.join(flow, "node", "left").select("node", "sink", "jump", score.alias("score"), (score - F.col("score")).alias("change"))
            before = path
            path, m = store_measuring(after, "rank", lost=lost_mass, moved=F.sum(F.col("change") * F.col("change")), length=F.sum(F.col("score") * F.col("score")))
            discard(spark, before)
            if tolerance is not None and m["moved"] <= tolerance**2 * m["length"]:
                break
        return keep(load(spark, path, start).select("node", F.round("score", decimals).alias("score")), "scores")


def attribute_jump(rows: DataFrame, attributes: list[str], gamma: float | None = None) -> DataFrame:
    """(node, weight): how alike each node's attributes are to those of all nodes.

    The likeness exp(-gamma |x - y|^2) of standardised attributes (gamma = 1 / their number),
    its mixed term expanded to second order, is a polynomial in one node's attributes whose
    coefficients are sums over all nodes; so one aggregation replaces the comparison of pairs.
    Constant attributes count as 0, nulls as the attribute's mean.
    """
    d = len(attributes)
    if not 0 < d <= MOST_ATTRIBUTES:
        raise ValueError(f"{d} attributes; 1 to {MOST_ATTRIBUTES} are allowed")
    gamma = 1.0 / d if gamma is None else gamma
    stats = rows.agg(*[f(F.col(a).cast("double")).alias(f"{k}{i}") for i, a in enumerate(attributes) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # one row
    mean, spread = [stats[f"m{i}"] or 0.0 for i in range(d)], [stats[f"s{i}"] or 0.0 for i in range(d)]
    z = [F.coalesce((F.col(a).cast("double") - mean[i]) / spread[i], F.lit(0.0)) if spread[i] else F.lit(0.0) for i, a in enumerate(attributes)]
    x = rows.select("node", *[c.alias(f"x{i}") for i, c in enumerate(z)])
    own = F.exp(-gamma * sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(d)), F.lit(0.0)))
    x = x.withColumn("w", own)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = x.agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"x{i}")).alias(f"x{i}") for i in range(d)], *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"x{i}_{j}") for i, j in pairs])  # one row
    both = x.crossJoin(F.broadcast(sums.select([F.col(c).alias(f"t_{c}") for c in sums.columns])))
    linear = sum((F.col(f"x{i}") * F.col(f"t_x{i}") for i in range(d)), F.lit(0.0))
    square = sum((F.col(f"x{i}") * F.col(f"x{j}") * F.col(f"t_x{i}_{j}") * (1.0 if i == j else 2.0) for i, j in pairs), F.lit(0.0))
    return both.select("node", (F.col("w") * (F.col("t_w") + 2 * gamma * linear + 2 * gamma * gamma * square)).alias("weight"))


def distances(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(seed, node, dist): fewest steps along edges from each seed; beyond ``limit`` steps none."""
    spark = edges.sparkSession
    edges = materialize(edges.select("src", "dst").distinct(), "steps")
    start = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("dist", F.lit(0))
    path, n = store_counting(start, "dist", all="true")
    paths, step = [path], 0
    while n["all"] and (limit is None or step < limit):
        step += 1
        seen = spark.read.schema(start.schema).parquet(*paths)
        frontier = load(spark, paths[-1], start)
        nxt = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        fresh = nxt.join(seen, ["seed", "node"], "left_anti").withColumn("dist", F.lit(step))
        path, n = store_counting(fresh.select(*start.columns), "dist", all="true")
        paths.append(path)
    return spark.read.schema(start.schema).parquet(*paths)


def distance_histogram(dist: DataFrame, n_pairs: DataFrame, most: int = 20) -> DataFrame:
    """(dist, n): pairs by distance; ``most + 1`` holds the farther ones and ``most + 2`` those without a way. ``n_pairs`` (n): one row, all pairs."""
    near = dist.groupBy(F.least("dist", F.lit(most + 1)).alias("dist")).agg(F.count("*").alias("n"))
    none = n_pairs.crossJoin(dist.agg(F.count("*").alias("r"))).select(F.lit(most + 2).alias("dist"), (F.col("n") - F.col("r")).alias("n"))  # one row each
    return near.unionByName(none.where("n > 0"))


def _weighted_distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, dist): least sum of weights from each seed, relaxed until nothing changes."""
    spark = edges.sparkSession
    start = seeds.select(F.col("node").alias("seed"), "node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"))
    path, n = store_counting(start, "relax", fresh="fresh")
    while n["fresh"]:
        state = load(spark, path, start)
        steps = state.where("fresh").join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), F.lit(False).alias("old"))
        both = state.select("seed", "node", "dist", F.lit(True).alias("old")).unionByName(steps).groupBy("seed", "node").agg(F.min("dist").alias("dist"), F.min(F.when(F.col("old"), F.col("dist"))).alias("was"))
        before = path
        path, n = store_counting(both.select("seed", "node", "dist", (F.col("was").isNull() | (F.col("dist") < F.col("was"))).alias("fresh")), "relax", fresh="fresh")
        discard(spark, before)
    return load(spark, path, start).select("seed", "node", "dist")


def _path_counts(start: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, n): number of walks from the start rows (*keys, node, n) along the acyclic steps (seed, src, dst)."""
    spark = start.sparkSession
    path, n = store_counting(start, "counts", all="true")
    paths = [path]
    while n["all"]:
        frontier = load(spark, paths[-1], start)
        ahead = frontier.join(steps, (frontier["seed"] == steps["seed"]) & (frontier["node"] == steps["src"]))
        path, n = store_counting(ahead.groupBy(*[frontier[k] for k in keys], F.col("dst").alias("node")).agg(F.sum("n").alias("n")), "counts", all="true")
        paths.append(path)
    return spark.read.schema(start.schema).parquet(*paths).groupBy(*keys, "node").agg(F.sum("n").alias("n"))


def shortest_path_scores(edges: DataFrame, seeds: DataFrame, least: float = 0.001) -> DataFrame:
    """(node, score): share of all shortest paths between different seeds that have the node inside.

    Weights, at least ``least``, are distances; edges from seed to seed do not count; paths may
    have any number of steps, and all of equal length count.
    """
    seeds = materialize(seeds.select("node").distinct(), "seeds")
    marked = lambda c: seeds.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_seed"))
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w")).join(marked("src"), "src", "left").join(marked("dst"), "dst", "left")
    e = materialize(e.where("src_seed IS NULL OR dst_seed IS NULL").select("src", "dst", F.greatest("w", F.lit(least)).alias("weight")), "lengths")
    d = materialize(_weighted_distances(e, seeds), "dist")
    to = d.select(F.col("seed").alias("t_seed"), F.col("node").alias("t_node"), F.col("dist").alias("t_dist"))
    tight = d.join(e, F.col("node") == F.col("src")).join(to, (F.col("seed") == F.col("t_seed")) & (F.col("dst") == F.col("t_node"))).where(F.col("dist") + F.col("weight") == F.col("t_dist")).select("seed", "src", "dst")
    tight = materialize(tight, "tight")
    one = F.lit(1.0).alias("n")
    ahead = materialize(_path_counts(seeds.select(F.col("node").alias("seed"), "node", one), tight, ["seed"]), "ahead")
    ends = d.join(seeds, "node", "left_semi").where("seed <> node").select("seed", F.col("node").alias("end"), "node", one)
    back = _path_counts(ends, tight.select("seed", F.col("dst").alias("src"), F.col("src").alias("dst")), ["seed", "end"])
    through = materialize(back.select("seed", "end", "node", F.col("n").alias("m")).join(ahead, ["seed", "node"]).select("seed", "end", "node", (F.col("n") * F.col("m")).alias("n")), "through")
    total = through.where("node = end").agg(F.sum("n").alias("total"))  # one row
    inner = through.where("node <> seed AND node <> end").groupBy("node").agg(F.sum("n").alias("n"))
    return inner.crossJoin(F.broadcast(total)).select("node", F.round(F.col("n") / F.col("total"), 9).alias("score"))


def paths_up_to(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """(a, b, path): simple paths of at most ``hops`` steps between the given ends."""
    edges = edges.select("src", "dst").distinct()
    walk = pairs.select("a", "b", F.array("a").alias("path"))
    found = []
    for _ in range(hops):
        walk = walk.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("a", "b", F.concat("path", F.array("dst")).alias("path"))
        found.append(walk.where(F.element_at("path", -1) == F.col("b")))
        walk = walk.where(F.element_at("path", -1) != F.col("b"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return outs.join(ins, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def symmetric(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi")


def strongest(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest edges out of every node; the window's limit is applied before the shuffle as well."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def with_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes (node) of a filtered graph with the seeds, which may have lost all their edges."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(seeds.select("node")).distinct()
