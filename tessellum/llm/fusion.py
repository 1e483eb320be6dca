"""One ranking from several differently scaled scores.

Within its list (a query's items by one method) every score becomes its empirical percentile,
ties getting the average position, and the percentile becomes a normal score through the
inverse normal distribution.  Scales and shapes are gone then; an item's combined score is
the weighted mean of its normal scores over the methods of its query.

Positions need each list in order.  Ordinary lists are ordered by one window each.  Long
lists (more than ``LONG_LIST`` rows) are cut into bins at approximate quantiles, so no task
ever sorts more than a bin: exact counts of the bins give each bin's offset, and a score that
fills several quantiles on its own is spread by item and ranked from counts alone.

Defined results
---------------
* Rows count as in ``topn.list_rows``; an item counts once per list, with its highest score.
* A list of one item gives it the middle (0).  An item absent from one of its query's lists
  stands in that list's middle (0), so it cannot lead on one method alone.
* Combined scores are rounded to 9 decimals; equal ones share a rank, and where one item is
  asked for, the smaller item comes first.  Unknown methods weigh 1; null queries are one query.
* Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

LONG_LIST = 200_000
MOST_BROADCAST = 200_000  # bins of long lists that may be broadcast (some 100 bytes each)

# Coefficients of algorithm AS 241 (Wichura 1988), highest power last.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(table: tuple, x: Column) -> Column:
    def poly(c: tuple) -> Column:
        out = F.lit(c[-1])
        for v in c[-2::-1]:
            out = out * x + F.lit(v)
        return out

    return poly(table[0]) / poly(table[1])


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(TAIL, r - 1.6)).otherwise(_ratio(FAR_TAIL, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRAL, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * tail)


def _window_positions(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Adds lo, hi (first and last position among equal scores, ascending) and n within ``keys``."""
    w = Window.partitionBy(*keys)
    up = w.orderBy(score)
    return rows.withColumns({"lo": F.rank().over(up).cast("bigint"), "hi": F.count(F.lit(1)).over(up), "n": F.count(F.lit(1)).over(w)})


def positions(rows: DataFrame, keys: list[str], item: str, score: str, combine: bool = True, counted: DataFrame | None = None) -> DataFrame:
    """Rows (keys, item, score) with the ascending position range lo..hi of their score in their group and its size n.

    With ``combine``, repeated items of a group count once with the highest score.  ``counted``
    (keys, rows_n): the rows of each group, if they are known.
    """
    rows = rows.select(*keys, item, score)
    sizes = (counted if counted is not None else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_n"))).where(F.col("rows_n") > LONG_LIST)
    longest = sizes.agg(F.max("rows_n").alias("m"), F.count(F.lit(1)).alias("c")).first()

    def merged(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys, item).agg(F.max(score).alias(score)) if combine else part

    if not longest["c"]:
        return _window_positions(merged(rows.repartition(*keys)), keys, score)
    bins = max(2, -(-2 * longest["m"] // LONG_LIST))
    cuts = [i / bins for i in range(1, bins)]
    same = lambda a, b: [a[k].eqNullSafe(b[f"l_{k}"]) for k in keys]
    fits = longest["c"] * bins <= MOST_BROADCAST
    maybe = F.broadcast if fits else (lambda x: x)
    names = materialize(sizes.select([F.col(k).alias(f"l_{k}") for k in keys]), "long_lists")
    long_rows = rows.join(maybe(names), same(rows, names), "left_semi")
    short_rows = rows.join(maybe(names), same(rows, names), "left_anti")
    bounds = materialize(long_rows.groupBy(*keys).agg(F.percentile_approx(score, cuts, max(10_000, 20 * bins)).alias("bounds")).select([F.col(k).alias(f"l_{k}") for k in keys] + ["bounds"]), "bounds")
    once = merged(long_rows)
    placed = once.join(maybe(bounds), same(once, bounds), "left").drop(*[f"l_{k}" for k in keys])
    equal = F.size(F.filter("bounds", lambda b: b == F.col(score)))
    placed = placed.select(
        *keys, item, score,
        F.size(F.filter("bounds", lambda b: b < F.col(score))).alias("bin"),
        (equal > 1).alias("heavy"),
        F.when(equal > 1, F.pmod(F.xxhash64(item), equal)).otherwise(F.lit(0)).alias("salt"),
    )
    cells = placed.groupBy(*keys, "bin", "heavy").agg(F.count(F.lit(1)).alias("cell_n"))
    line = Window.partitionBy(*keys).orderBy("bin", "heavy")  # as many rows as bins
    cells = materialize(
        cells.withColumns({"before": F.sum("cell_n").over(line) - F.col("cell_n"), "n": F.sum("cell_n").over(Window.partitionBy(*keys))}).select([F.col(k).alias(f"l_{k}") for k in keys] + [F.col("bin").alias("l_bin"), F.col("heavy").alias("l_heavy"), "cell_n", "before", F.col("n").alias("list_n")]),
        "cells",
    )
    ranked = _window_positions(placed, [*keys, "bin", "heavy", "salt"], score)
    ranked = ranked.join(maybe(cells), [*same(ranked, cells), ranked["bin"] == cells["l_bin"], ranked["heavy"] == cells["l_heavy"]])
    long_out = ranked.select(
        *keys, item, score,
        (F.col("before") + F.when(F.col("heavy"), F.lit(1)).otherwise(F.col("lo"))).alias("lo"),
        (F.col("before") + F.when(F.col("heavy"), F.col("cell_n")).otherwise(F.col("hi"))).alias("hi"),
        F.col("list_n").alias("n"),
    )
    return _window_positions(merged(short_rows.repartition(*keys)), keys, score).unionByName(long_out)


def _packed(item: Column) -> Column:
    """A shorter reversible form of ids of 40 hexadecimal digits for the shuffles."""
    return F.when(item.rlike("^[0-9a-f]{40}$"), F.concat(F.lit(b"\1"), F.unhex(item))).otherwise(F.concat(F.lit(b"\0"), F.encode(item, "UTF-8")))


def _unpacked(packed: Column) -> Column:
    body = F.substring(packed, 2, 2_000_000_000)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\1"), F.lower(F.hex(body))).otherwise(F.decode(body, "UTF-8"))


def list_sizes(lists: DataFrame) -> DataFrame:
    """(query_id, method, rows_n), stored: read for long lists as well as for the methods of each query."""
    return materialize(lists.groupBy("query_id", "method").agg(F.count(F.lit(1)).alias("rows_n")), "list_sizes")


def combined_scores(lists: DataFrame, sizes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, item (packed), total): the weighted sum of the normal scores of ``topn.list_rows``."""
    rows = lists.select("query_id", "method", _packed(F.col("entry_item")).alias("item"), "entry_score")
    placed = positions(rows, ["query_id", "method"], "item", "entry_score", counted=sizes)
    z = normal_quantile(((F.col("lo") + F.col("hi")) / 2 - 0.5) / F.col("n"))
    return placed.withColumn("z", z * _weight(weights)).groupBy("query_id", "item").agg(F.sum("z").alias("total"))


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col("method")), F.lit(1.0))


def _query_weights(sizes: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    return sizes.groupBy(F.col("query_id").alias("w_query")).agg(F.sum(_weight(weights)).alias("weight"), F.count(F.lit(1)).alias("n_methods"))


def fuse(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, entry_item, score, rank (1 is best; equal scores share a rank)."""
    sizes = list_sizes(lists)
    totals, per_query = combined_scores(lists, sizes, weights), _query_weights(sizes, weights)
    mean = totals.join(per_query, totals["query_id"].eqNullSafe(per_query["w_query"])).select("query_id", "item", F.round(F.col("total") / F.col("weight"), 9).alias("score"))
    placed = positions(materialize(mean, "means"), ["query_id"], "item", "score", combine=False)
    return placed.select("query_id", _unpacked(F.col("item")).alias("entry_item"), "score", (F.col("n") - F.col("hi") + 1).cast("bigint").alias("rank"))


def leaders(lists: DataFrame, weights: dict[str, float] | None = None, least_methods: int = 1, least_items: int = 1) -> DataFrame:
    """(query_id, entry_item): the head of each query's combined ranking."""
    sizes = list_sizes(lists)
    totals, per_query = combined_scores(lists, sizes, weights), _query_weights(sizes, weights)
    heads = totals.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_items"), F.min(F.struct((-F.round("total", 9)).alias("down"), _unpacked(F.col("item")).alias("entry_item"))).alias("head")).where(F.col("n_items") >= least_items)
    per_query = per_query.where(F.col("n_methods") >= least_methods)
    return heads.join(per_query, heads["query_id"].eqNullSafe(per_query["w_query"])).select("query_id", "head.entry_item")
