"""Parent-child rows to full hierarchies.

Frontier joins start from the roots.  Level by level the frontier (the nodes reached last)
meets the nodes that still wait for their parent; those it reaches extend its paths and
depths by one and are the next frontier.  The few nodes below level ``LEVELS`` are reached in
bands that double, since a job for every level of a long chain would take hours: each waiting
node knows its ancestor ``2**k`` levels up, so a frontier join reaches a band of ``2**k``
levels at once, and nodes that no frontier meets double their reach (those whose path repeats
a node leave: no root is above them).

When a frontier is empty, the nodes that were never reached from a root lie on a cycle or
hang below one.  From each of them a walk goes upwards, in steps that double, until
it must have repeated itself; the nodes such walks still come by are exactly those on cycles,
and the smallest id seen on the way names the cycle.

Defined results
---------------
* Rows with a null id are no nodes.  Repeated ids are one node: the row of the latest
  ``loaded_at`` counts (then the larger parent, then the larger title).
* A node without parent, or whose parent is no node, is a root (``orphan`` marks the second).
* Titles are trimmed and runs of white space become one blank; null titles count as ``""``.
* Nodes on or below a cycle have no path, depth or root; they come out in ``cycles``.
* Extra columns are ignored whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, load, store, store_counting

LEVELS = 4  # levels reached one by one; beyond, in bands


@dataclass(frozen=True)
class Hierarchy:
    """``nodes``: id, depth, root, orphan[, id_path, title_path]; ``unreached``: id, parent."""

    nodes: DataFrame
    unreached: DataFrame


def tidy_title(title: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(title, r"(?U)\s+", " ")), F.lit(""))


def latest_nodes(rows: DataFrame, id_col: str = "id", parent_col: str = "parent", title_col: str = "title", time_col: str = "loaded_at") -> DataFrame:
    """One row (id, parent, title) per node; partial aggregation runs before the shuffle."""
    picked = rows.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.struct(F.col(time_col).alias("t"), F.col(parent_col).cast("bigint").alias("parent"), tidy_title(F.col(title_col)).alias("title")).alias("row"),
    ).where("id IS NOT NULL")
    return picked.groupBy("id").agg(F.max("row").alias("row")).select("id", "row.parent", "row.title")


def resolve(nodes: DataFrame, paths: bool = True) -> Hierarchy:
    """Resolve (id, parent, title) into paths, depths and roots.

    With ``paths=False`` neither ids nor titles of the ancestors are carried along.
    """
    spark = nodes.sparkSession
    parents = nodes.select(F.col("id").alias("p_id"))
    known = nodes.join(parents, nodes["parent"] == parents["p_id"], "left")
    is_root = F.col("p_id").isNull()
    # top: the root if reached, else the ancestor `hops` levels up; hops: the depth once reached
    start = known.select(
        "id",
        is_root.alias("done"),
        F.when(is_root, F.col("id")).otherwise(F.col("parent")).alias("top"),
        F.when(is_root, F.lit(0)).otherwise(F.lit(1)).alias("hops"),
        (is_root & F.col("parent").isNotNull()).alias("orphan"),
        *([F.array("id").alias("ids"), F.array("title").alias("titles")] if paths else []),
    )
    path, n = store_counting(start, "level", waiting="NOT done")
    written = [path]
    frontier, waiting = _split(load(spark, path, start))
    level, met_last = 0, True
    while n["waiting"] and met_last and level < LEVELS:
        f = frontier.select([F.col(c).alias(f"u_{c}") for c in frontier.columns])
        met = F.col("u_id").isNotNull()
        met_or = lambda c, new: F.when(met, new).otherwise(F.col(c)).alias(c)
        moved = waiting.join(f, F.col("top") == F.col("u_id"), "left").select(
            "id",
            met.alias("done"),
            met_or("top", F.col("u_top")),
            met_or("hops", F.col("u_hops") + 1),
            met_or("orphan", F.col("u_orphan")),
            *([met_or("ids", F.concat("u_ids", "ids")), met_or("titles", F.concat("u_titles", "titles"))] if paths else []),
        )
        path, n = store_counting(moved, "level", waiting="NOT done", met="done")
        written.append(path)
        frontier, waiting = _split(load(spark, path, start))
        level, met_last = level + 1, n["met"] > 0
    while n["waiting"] and met_last:  # deeper than LEVELS: each round reaches a band as deep as all bands before it
        # what waiting nodes point at is never above the last level
        up = spark.read.schema(start.schema).parquet(*written[level:]).where("done").unionByName(waiting)
        up = up.select([F.col(c).alias(f"u_{c}") for c in up.columns])
        moved = waiting.join(up, F.col("top") == F.col("u_id")).select(
            "id",
            F.col("u_done").alias("done"),
            F.col("u_top").alias("top"),
            (F.col("hops") + F.col("u_hops")).alias("hops"),
            F.col("u_orphan").alias("orphan"),
            *([F.concat("u_ids", "ids").alias("ids"), F.concat("u_titles", "titles").alias("titles")] if paths else []),
        )
        if paths:  # a walk that meets a node again never meets a root; without this its path would double until the end
            moved = moved.where("done OR NOT array_contains(ids, top)")
        path, n = store_counting(moved, "level", waiting="NOT done", met="done")
        written.append(path)
        waiting, met_last = _split(load(spark, path, start))[1], n["met"] > 0
    reached = spark.read.schema(start.schema).parquet(*written).where("done")
    done = reached.select("id", F.col("hops").alias("depth"), F.col("top").alias("root"), "orphan", *([F.col("ids").alias("id_path"), F.col("titles").alias("title_path")] if paths else []))
    return Hierarchy(done, nodes.select("id", "parent").join(reached.select("id"), "id", "left_anti"))


def _split(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    return state.where("done"), state.where(~F.col("done"))


def cycles(unreached: DataFrame) -> DataFrame:
    """(cycle_id, id) of the nodes that are their own ancestors.

    ``unreached`` holds nodes whose every ancestor is unreached too, as ``resolve`` leaves them.
    """
    spark = unreached.sparkSession
    start = unreached.select("id", F.col("parent").alias("top"), F.least("id", "parent").alias("low"))
    path = store(start, "cycles")
    state = load(spark, path, start)
    total, span = state.count(), 1
    while span < total:
        up = state.select(F.col("id").alias("u_id"), F.col("top").alias("u_top"), F.col("low").alias("u_low"))
        after = state.join(up, F.col("top") == F.col("u_id")).select("id", F.col("u_top").alias("top"), F.least("low", "u_low").alias("low"))
        new = store(after, "cycles")
        discard(spark, path)
        path, span = new, span * 2
        state = load(spark, path, start)
    on_cycle = state.select(F.col("top").alias("c_id")).distinct()
    return state.join(on_cycle, F.col("id") == F.col("c_id"), "left_semi").select(F.col("low").cast("int").alias("cycle_id"), F.col("id").cast("int").alias("id"))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, id, distance) for every resolved node and each of its proper ancestors."""
    at = F.posexplode(F.slice("id_path", 1, F.size("id_path") - 1)).alias("pos", "ancestor")
    return nodes.where("depth > 0").select("id", "depth", at).select("ancestor", "id", (F.col("depth") - F.col("pos")).alias("distance"))


def _ancestors_of_unreached(unreached: DataFrame) -> DataFrame:
    """(id, ancestor, level) of the nodes that ``resolve`` leaves; levels double each round until no pair is new."""
    spark = unreached.sparkSession
    start = unreached.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    path = store(start, "ancestors")
    state = load(spark, path, start)
    total, before = state.count(), -1
    while total > before:
        up = state.select(F.col("id").alias("u_id"), F.col("ancestor").alias("u_ancestor"), F.col("level").alias("u_level"))
        far = state.join(up, F.col("ancestor") == F.col("u_id")).select("id", F.col("u_ancestor").alias("ancestor"), (F.col("level") + F.col("u_level")).alias("level"))
        new = store(state.unionByName(far).groupBy("id", "ancestor").agg(F.min("level").alias("level")), "ancestors")
        discard(spark, path)
        path, state = new, load(spark, new, start)
        total, before = state.count(), total
    return state


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, level) for every node and everything above it, without a bound on the level.

    A parent that is no node counts as an ancestor.  On or below a cycle each ancestor comes
    once, at its smallest level; nodes on a cycle are their own ancestors.
    """
    h = resolve(nodes)
    above = descendants(h.nodes).select("id", "ancestor", F.col("distance").alias("level"))
    missing = h.nodes.where("orphan").join(nodes.select(F.col("id").alias("root"), F.col("parent").alias("ancestor")), "root").select("id", "ancestor", (F.col("depth") + 1).alias("level"))
    return above.unionByName(missing).unionByName(_ancestors_of_unreached(h.unreached))
