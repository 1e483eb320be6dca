"""Learning to rank and classifying with feature arrays; rows stay distributed, models are small.

Every round is one pass over the rows that adds up a bounded number of sums.  The number of
features is checked (``MOST_FEATURES``); nothing else depends on the data's size.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

MOST_FEATURES = 200
COSTS = tuple(2.0**k for k in range(-12, 8))  # the grid of 20
OFFSETS = (-2.0, -0.5, -0.1, 0.0, 0.1, 0.5, 2.0)


def _width(rows: DataFrame) -> int:
    n = rows.agg(F.max(F.size("features"))).first()[0] or 0
    if n > MOST_FEATURES:
        raise ValueError(f"{n} features; at most {MOST_FEATURES} are allowed")
    return n


def standardised(rows: DataFrame) -> tuple[DataFrame, list[float], list[float]]:
    """(rows with standardised ``features``, means, deviations); constant features become 0."""
    n = _width(rows)
    stats = rows.agg(*[f(F.col("features")[i]).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if n else {}
    mean, spread = [stats[f"m{i}"] or 0.0 for i in range(n)], [stats[f"s{i}"] or 0.0 for i in range(n)]
    z = F.array(*[(F.col("features")[i] - mean[i]) / spread[i] if spread[i] else F.lit(0.0) for i in range(n)]).cast("array<double>")
    return rows.withColumn("features", z), mean, spread


def raw_weights(weights: list[float], spread: list[float]) -> list[float]:
    """Weights of standardised features as weights of the features themselves (the constant they leave does not order anything)."""
    return [w / s if s else 0.0 for w, s in zip(weights, spread)]


def positive_weight(score: Column, kind: str, least: Column | None = None, denormal: Column | None = None) -> Column:
    """Edge weights above 0 from scores: exp, logistic, cut (negative ones become 0), linear (above ``least``, plus 1), denormal-exp (exp of ``denormal``)."""
    kinds = {
        "exp": lambda: F.exp(score),
        "logistic": lambda: 1 / (1 + F.exp(-score)),
        "cut": lambda: F.greatest(score, F.lit(0.0)),
        "linear": lambda: score - least + 1.0,
        "denormal-exp": lambda: F.exp(denormal),
    }
    return kinds[kind]()


def balanced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As many rows of label 0 as of label 1: those of smallest hash, told by counts for each leading part of the hash."""
    h = rows.withColumn("_h", F.md5(F.concat_ws("|", *keys))).withColumn("_cell", F.substring("_h", 1, 3))
    cells = h.groupBy("label", "_cell").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.partitionBy("label").orderBy("_cell")) - F.col("_c"))  # 4096 cells a label
    least = h.groupBy("label").agg(F.count("*").alias("n")).agg(F.when(F.count("*") > 1, F.min("n")).otherwise(0).alias("_least"))  # one row
    placed = h.withColumn("_k", F.row_number().over(Window.partitionBy("label", "_cell").orderBy("_h"))).join(F.broadcast(cells), ["label", "_cell"]).crossJoin(F.broadcast(least))
    return placed.where(F.col("_before") + F.col("_k") <= F.col("_least")).drop("_h", "_cell", "_c", "_before", "_k", "_least")


def svm_grid(rows: DataFrame, costs: tuple[float, ...] = COSTS, rounds: int = 30) -> list[tuple[float, float, list[float]]]:
    """(cost, F1 on held-out rows, weights with the constant last) of linear classifiers, the best first (equal F1: the smaller cost).

    Rows: features array<double>, label 0 or 1, held boolean.  All costs are fitted side by side
    by Newton steps on the squared hinge loss; a step that does not lower the loss is halved.
    """
    rows = materialize(rows.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"), "held"), "svm")
    d, k = _width(rows) + 1, len(costs)
    spark, c = rows.sparkSession, np.array(costs)

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(batch.column("features").flatten()).reshape(batch.num_rows, d - 1)
        return np.c_[x, np.ones(len(x))], batch.column("label").to_numpy() * 2.0 - 1

    def sums(w: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(w)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, 1 + d + d * d))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = points(batch)
                slack = np.maximum(1 - y[:, None] * (x @ shared.value.T), 0)
                total[:, 0] += (slack**2).sum(axis=0)
                total[:, 1 : 1 + d] -= 2 * (slack * y[:, None]).T @ x
                for j in range(k):
                    hit = x[slack[:, j] > 0]
                    total[j, 1 + d :] += 2 * (hit.T @ hit).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

        got = rows.where("NOT held").select("features", "label").mapInArrow(work, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(k * (1 + d + d * d))
        out[got["cell"].to_numpy()] = got["v"].to_numpy()
        shared.unpersist()
        return out.reshape(k, -1)

    w = np.zeros((k, d))
    best, best_loss, step = w.copy(), np.full(k, np.inf), np.zeros((k, d))
    for _ in range(rounds):
        s = sums(w)
        loss = 0.5 * (w * w).sum(axis=1) + c * s[:, 0]
        better = loss < best_loss
        known = np.isfinite(best_loss)
        moved = np.full(k, np.inf)
        moved[known] = (best_loss[known] - loss[known]) / np.maximum(best_loss[known], 1e-300)
        for j in np.flatnonzero(better):
            best[j], best_loss[j] = w[j], loss[j]
            gradient, hessian = w[j] + c[j] * s[j, 1 : 1 + d], np.eye(d) + c[j] * s[j, 1 + d :].reshape(d, d)
            step[j] = -np.linalg.solve(hessian, gradient)
        step[~better] /= 2
        if (np.abs(moved) < 1e-7).all() or (np.abs(step).max(axis=1) < 1e-9).all():
            break
        w = best + step
    final = spark.sparkContext.broadcast(best)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((k, 3), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, y = points(batch)
                yes, true = x @ final.value.T > 0, y[:, None] > 0
                n += np.stack([(yes & true).sum(axis=0), (yes & ~true).sum(axis=0), (~yes & true).sum(axis=0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *(pa.array(n[:, i]) for i in range(3))], names=["j", "tp", "fp", "fn"])

    counts = rows.where("held").select("features", "label").mapInArrow(judge, "j bigint, tp bigint, fp bigint, fn bigint").groupBy("j").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).collect()  # one row a cost
    f1 = {r["j"]: 2 * r["tp"] / max(1, 2 * r["tp"] + r["fp"] + r["fn"]) for r in counts}
    return sorted(((float(c[j]), f1.get(j, 0.0), best[j].tolist()) for j in range(k)), key=lambda x: (-x[1], x[0]))


def coordinate_ascent(rows: DataFrame, relevant: DataFrame, folds: int = 3, cutoff: int = 100, passes: int = 10, batch: int = 1) -> tuple[list[list[float]], list[float], list[float], list[float]]:
    """(weights of each fold, MAP on its training queries, MAP on its held-out ones, deviations of the features).

    Rows: query_id, doc_id, features.  One coordinate after another takes the offset that gives
    the best mean average precision (at ``cutoff``) of the fold's training queries; passes go on
    until no fold gains.  With ``batch`` > 1 each step looks at one of that many parts of the
    queries in turn.  The folds are queries by hash; all folds and offsets of a step are scored
    in one job, and one mean for each comes back.
    """
    fold = F.pmod(F.xxhash64("query_id"), F.lit(folds)).cast("int").alias("fold")
    z, _, spread = standardised(rows.select("query_id", "doc_id", F.col("features").cast("array<double>").alias("features")))
    part = F.pmod(F.xxhash64("query_id", F.lit("part")), F.lit(batch)).alias("part")
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = relevant.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct()
    z = z.join(total, "query_id").join(hits, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "features", "n_rel", F.coalesce("hit", F.lit(0)).alias("hit"), fold, part)
    z = materialize(z, "ranking_rows")
    n, many = len(spread), len(OFFSETS)
    weights = [[1.0] * n for _ in range(folds)]

    def scored(candidates: list[list[float]], each: int, some: Column) -> dict[tuple[int, int, bool], float]:
        """MAP by (fold, option, held out) of the candidates' weights, ``each`` of them for every fold in turn."""
        matrix = np.array(candidates).T

        @F.arrow_udf("array<double>")
        def scores(x: pa.Array) -> pa.Array:
            y = np.asarray(x.flatten()).reshape(len(x), -1) @ matrix
            return pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], np.int32)), pa.array(y.ravel()))

        lists = z.where(some).select("query_id", "doc_id", "fold", "hit", "n_rel", F.posexplode(scores("features")).alias("c", "score"))
        place = Window.partitionBy("query_id", "c").orderBy(F.desc("score"), "doc_id")
        top = lists.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= cutoff)
        gains = top.withColumn("gain", F.col("hit") * F.sum("hit").over(Window.partitionBy("query_id", "c").orderBy("rank")) / F.col("rank") / F.col("n_rel"))
        ap = gains.groupBy("query_id", "c", "fold").agg(F.sum("gain").alias("ap"))
        f = F.floor(F.col("c") / each).cast("int")
        means = ap.groupBy("c", (F.col("fold") == f).alias("held")).agg(F.avg("ap").alias("m")).collect()  # two rows a candidate
        return {(r["c"] // each, r["c"] % each, r["held"]): r["m"] for r in means}

    best, turn = [-1.0] * folds, 0
    for _ in range(passes):
        gained = False
        for i in range(n):
            options = [[w + (offset if g == i else 0.0) for g, w in enumerate(weights[f])] for f in range(folds) for offset in OFFSETS]
            means = scored(options, many, F.col("part") == turn % batch)
            turn += 1
            for f in range(folds):
                mine = {o: means[(f, o, False)] for o in range(many) if (f, o, False) in means}
                if not mine:
                    continue
                top = max(mine, key=lambda o: (mine[o], -abs(OFFSETS[o])))
                if mine[top] > mine.get(OFFSETS.index(0.0), -1.0) + 1e-9:
                    weights[f][i] += OFFSETS[top]
                    gained = True
                best[f] = max(best[f], mine[top]) if batch == 1 else mine[top]
        if not gained:
            break
    else:
        warnings.warn(f"weights still moved after {passes} passes", stacklevel=2)
    final = scored(weights, 1, F.lit(True))
    return weights, [final.get((f, 0, False), 0.0) for f in range(folds)], [final.get((f, 0, True), 0.0) for f in range(folds)], spread


def category_vectors(categories: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, indices) and the dictionary (index, category): the ``most`` commonest categories as positions of binary vectors.

    ``categories``: id, category.  Equally common ones are taken in order of their names.
    """
    n = categories.distinct().groupBy("category").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "category").limit(most)
    words = materialize(top, "dictionary").withColumn("index", F.row_number().over(Window.orderBy(F.desc("n"), "category")) - 1).select("index", "category")  # `most` rows
    vectors = categories.join(F.broadcast(words), "category").groupBy("id").agg(F.sort_array(F.collect_set("index")).alias("indices"))
    return vectors, words
