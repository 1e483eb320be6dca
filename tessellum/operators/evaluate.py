"""Ranking quality, correlation and agreement; all plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def average_precision(ranked: DataFrame, relevant: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, *keys, ap): ``ranked``: query_id, doc_id, rank, keys; ``relevant``: query_id, doc_id. Queries without a relevant item do not count."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("query_id", *keys).orderBy("rank")
    gains = hits.withColumn("p", F.col("hit") * F.sum("hit").over(w) / F.col("rank"))
    return gains.groupBy("query_id", *keys).agg(F.sum("p").alias("s")).join(total, "query_id").select("query_id", *keys, (F.col("s") / F.col("n_rel")).alias("ap"))


def precision_recall(ranked: DataFrame, relevant: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(query_id, *keys, precision, recall, f1) at ``depth``."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    top = ranked.where(F.col("rank") <= depth).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    counts = top.groupBy("query_id", *keys).agg(F.count("*").alias("n"), F.count("hit").alias("tp")).join(total, "query_id")
    p, r = safe_ratio(F.col("tp"), F.col("n")), safe_ratio(F.col("tp"), F.col("n_rel"))
    return counts.select("query_id", *keys, p.alias("precision"), r.alias("recall"), F.coalesce(safe_ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def kendall_tau(ranks: DataFrame) -> DataFrame:
    """One row from (system, rank_a, rank_b): pairs ordered alike against all pairs."""
    a = ranks.select(F.col("system").alias("x"), F.col("rank_a").alias("xa"), F.col("rank_b").alias("xb"))
    b = ranks.select(F.col("system").alias("y"), F.col("rank_a").alias("ya"), F.col("rank_b").alias("yb"))
    pairs = a.join(b, F.col("xa") < F.col("ya"))  # systems, not items
    return pairs.agg(F.count("*").alias("n_pairs"), F.sum((F.col("xb") < F.col("yb")).cast("int")).alias("c")).select("n_pairs", ((2 * F.col("c") - F.col("n_pairs")) / F.col("n_pairs")).alias("tau"))


def spearman_rho(ranks: DataFrame) -> DataFrame:
    d2 = F.sum((F.col("rank_a") - F.col("rank_b")) ** 2)
    return ranks.agg(F.count("*").alias("n"), d2.alias("d2")).select("n", (1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") ** 2 - 1))).alias("rho"))


def cronbach_alpha(scores: DataFrame) -> DataFrame:
    """One row from (query_id, system, value): queries are items, systems are subjects."""
    k = scores.agg(F.count_distinct("query_id").alias("k"))
    items = scores.groupBy("query_id").agg(F.var_pop("value").alias("v")).agg(F.sum("v").alias("items"))
    total = scores.groupBy("system").agg(F.sum("value").alias("t")).agg(F.var_pop("t").alias("total"))
    return k.crossJoin(items).crossJoin(total).select("k", (F.col("k") / (F.col("k") - 1) * (1 - F.col("items") / F.col("total"))).alias("alpha"))


def cohen_kappa(pairs: DataFrame, a: str = "rel_a", b: str = "rel_b", keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, n, kappa) from rows of two labels of the same item."""
    n = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("c"))
    side = lambda col: n.groupBy(*keys, F.col(col).alias("g")).agg(F.sum("c").alias(f"n_{col}"))
    total = n.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    chance = side(a).join(side(b), [*keys, "g"]).groupBy(*keys).agg(F.sum(F.col(f"n_{a}") * F.col(f"n_{b}")).alias("m"))
    joined = total.join(chance, list(keys), "left") if keys else total.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.coalesce("m", F.lit(0)) / (F.col("n") * F.col("n"))
    return joined.select(*keys, "n", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(labels: DataFrame, raters: int) -> DataFrame:
    """One row over the items with exactly ``raters`` labels, from (item, label)."""
    full = labels.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") == raters).select("item")
    counts = labels.join(full, "item", "left_semi").groupBy("item", "label").agg(F.count("*").alias("c"))
    per_item = counts.groupBy("item").agg(((F.sum(F.col("c") * F.col("c")) - raters) / (raters * (raters - 1))).alias("p"))
    observed = per_item.agg(F.count("*").alias("n_items"), F.avg("p").alias("p_bar"))
    share = counts.groupBy("label").agg(F.sum("c").alias("t"))
    chance = share.crossJoin(observed.select("n_items")).agg(F.sum((F.col("t") / (F.col("n_items") * raters)) ** 2).alias("pe"))
    return observed.crossJoin(chance).select("n_items", ((F.col("p_bar") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))
