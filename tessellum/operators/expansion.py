"""Entity rankings by walks over the graph around each query's best paragraphs.

For every cell of a grid (graph filter x edge weighting x retrieval model) and query the
ranked paragraphs give edges between the nodes they mention.  A query's graphs touch no other
query's, so a query is one row and all its cells are walked where it lies; only the numbers of
nodes and seeds, over which a walk's jumps are spread, are sums over all queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import load, store_measuring

WEIGHTINGS = ["count", "reciprocal"]
WALKS = ["pagerank", "personal", "margin"]
CHUNK_PAIRS = 1_000_000  # pairs of neighbours that are walked at once, about


@dataclass(frozen=True)
class Grid:
    """``filters``: name to the number of heaviest edges kept out of each node, None for all; walks: ``pagerank`` (jump to all nodes), ``personal`` (jump to the query's seeds), ``margin`` (sum of the weights out of the node)."""

    filters: dict[str, int | None]
    walks: list[str]
    models: list[str]
    seed_model: str
    seeds: int
    rounds: int
    teleport: float
    depth: int

    def __post_init__(self) -> None:
        if unknown := set(self.walks) - set(WALKS):
            raise ValueError(f"no such walks: {sorted(unknown)}")

    @property
    def cells(self) -> list[tuple[str, str]]:
        return [(g, w) for g in self.filters for w in WEIGHTINGS]


def query_rows(ranked: DataFrame, edge_docs: DataFrame) -> DataFrame:
    """(query_id, items): a query's documents of ``ranked`` (model, query_id, doc, rank), each with its nodes of ``edge_docs`` (doc, node)."""
    nodes = edge_docs.groupBy("doc").agg(F.count("*").alias("n"), F.collect_list("node").alias("nodes")).select("doc", F.col("n").cast("int").alias("n"), "nodes")  # a null node counts in n alone
    item = F.struct("model", "rank", "doc", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("nodes", F.array()).alias("nodes"))
    return ranked.join(nodes, "doc", "left").select("query_id", item.alias("item")).groupBy("query_id").agg(F.collect_list("item").alias("items"))


def _lists(a: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(length of each list, all members); no list is null."""
    return np.diff(np.asarray(a.offsets)).astype(np.int64), a.flatten()


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a value of sorted ``x`` stands first."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each row, from 0, in its group; rows of a group lie together."""
    begins = _starts(groups)
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.r_[begins, len(groups)]))


def _half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    return np.floor(x * 10.0**decimals + 0.5) / 10.0**decimals


class _Queries:
    """Some queries side by side.  A group is a query and a model, a name a node of a group; names are numbered by group and node, null nodes last."""

    def __init__(self, query_id: pa.Array, items: pa.ListArray, grid: Grid) -> None:
        items = _whole(items)
        self.grid, self.n_queries, n_models = grid, len(items), len(grid.models)
        size, item = _lists(items)
        model = np.asarray(pc.index_in(item.field("model"), pa.array(grid.models))).astype(np.int64)
        self.rank, self.doc = np.asarray(item.field("rank")).astype(np.int64), item.field("doc")
        group = np.repeat(np.arange(len(items)), size) * n_models + model
        known, nodes = _lists(item.field("nodes"))
        null = np.asarray(item.field("n")).astype(np.int64) > known
        self.nodes, code = np.unique(np.asarray(nodes), return_inverse=True)
        self.width = len(self.nodes) + 1
        self.known, owner = known, np.r_[np.repeat(np.arange(len(known)), known), np.flatnonzero(null)]
        key = group[owner] * self.width + np.r_[code, np.full(int(null.sum()), self.width - 1, np.int64)]
        self.names, self.name_of = np.unique(key, return_inverse=True)
        self.group, self.code = self.names // self.width, self.names % self.width
        self.query, self.model = self.group // n_models, self.group % n_models
        self.owner, self.n_known = owner, len(nodes)
        self.joined = np.zeros(len(self.names), bool)  # has a neighbour, so it is a node of every cell
        self.joined[self.name_of[: self.n_known][known[owner[: self.n_known]] > 1]] = True
        self.joined &= np.asarray(query_id.is_valid())[self.query]  # the null query has no graphs
        self.seeded = self._seeds()
        self.groups = np.ones(self.n_queries * n_models, bool)  # that are walked

    def parts(self) -> list[_Queries]:
        """Itself, or its models one by one if all their pairs at once would take much memory."""
        if (self.known**2).sum() <= 2 * CHUNK_PAIRS:
            return [self]
        out = []
        for m in range(len(self.grid.models)):
            part = copy(self)
            part.joined, part.groups = self.joined & (self.model == m), np.arange(len(self.groups)) % len(self.grid.models) == m
            out.append(part)
        return out

    def _seeds(self) -> np.ndarray:
        """Names of nodes that stand in most documents of the seed model; all documents count, also those of one node."""
        n_models, at = len(self.grid.models), np.flatnonzero(self.model == self.grid.models.index(self.grid.seed_model))
        count = np.bincount(self.name_of, minlength=len(self.names))[at]
        order = at[np.lexsort((self.code[at], -count, self.query[at]))]
        best = order[_places(self.query[order]) < self.grid.seeds]
        keys = ((self.query[best] * n_models)[:, None] + np.arange(n_models)) * self.width + self.code[best][:, None]
        return np.isin(self.names, keys) & self.joined

    def edges(self) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(src, dst, weights by weighting) over names, by src and dst."""
        begin = np.cumsum(self.known) - self.known
        times = np.where(self.joined[self.name_of[: self.n_known]], np.repeat(self.known, self.known), 0)  # of each entry: the entries of its document
        left = np.repeat(np.arange(self.n_known), times)
        right = np.repeat(begin[self.owner[: self.n_known]], times) + _places(left)
        fine = left != right
        left, right = left[fine], right[fine]
        key = self.name_of[left] * len(self.names) + self.name_of[right]
        order = np.argsort(key, kind="stable")
        begins, key = _starts(key[order]), key[order]
        if not len(begins):
            return np.empty(0, np.int64), np.empty(0, np.int64), {w: np.empty(0) for w in WEIGHTINGS}
        src, dst = key[begins] // len(self.names), key[begins] % len(self.names)
        count = np.diff(np.r_[begins, len(key)]).astype(float)
        reciprocal = np.add.reduceat(1.0 / self.rank[self.owner[left[order]]], begins)
        return src, dst, {"count": count, "reciprocal": _half_up(reciprocal, 12)}

    def scores(self, n_nodes: int, n_seeds: int) -> Iterator[tuple[str, str, str, np.ndarray]]:
        """(graph, weighting, walk, share of each name in its group's scores)."""
        g, n = self.grid, len(self.names)
        src, dst, weights = self.edges()
        jumps = {"pagerank": self.joined / max(n_nodes, 1), "personal": self.seeded / max(n_seeds, 1)}
        for graph, weighting in g.cells:
            s, d, w = src, dst, weights[weighting]
            if g.filters[graph] is not None:
                order = np.lexsort((d, -w, s))
                kept = order[_places(s[order]) < g.filters[graph]]
                s, d, w = s[kept], d[kept], w[kept]
            total = np.bincount(s, w, n)  # every node has an edge out, so no walk ends
            share = w / total[s]
            for walk in g.walks:
                if walk == "margin":
                    score = total
                else:
                    score = jump = jumps[walk]
                    for _ in range(g.rounds):
                        score = g.teleport * jump + (1 - g.teleport) * np.bincount(d, score[s] * share, n)
                    score = _half_up(score, 15)
                whole = np.bincount(self.group, score, self.n_queries * len(g.models))[self.group]
                yield graph, weighting, walk, _half_up(np.divide(score, whole, out=np.zeros(n), where=whole > 0), 9)

    def passages(self) -> np.ndarray:
        """The item, best by rank, in which each name stands."""
        order = np.lexsort((self.rank[self.owner], self.name_of))
        return self.owner[order[_starts(self.name_of[order])]]


def _chunks(items: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of queries of about ``CHUNK_PAIRS`` pairs."""
    size, item = _lists(items)
    known = np.diff(np.asarray(item.field("nodes").offsets)).astype(np.int64)
    cost = np.r_[0, np.cumsum(known * known)][np.cumsum(size)] if len(size) else np.empty(0)
    lo = 0
    while lo < len(items):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CHUNK_PAIRS, "right")))
        yield lo, hi
        lo = hi


def _whole(column: pa.Array) -> pa.ListArray:
    """Without offsets from slicing."""
    return pa.concat_arrays([column])


def method_runs(ranked: DataFrame, edge_docs: DataFrame, grid: Grid, nobody: int) -> DataFrame:
    """(method, query_id, node, score, rank, passage): the best nodes of every query, cell and walk, by their share in its scores; method is graph-weighting-walk-model.

    ``ranked``: model, query_id, doc, rank; ``edge_docs``: doc, node (a whole number).  ``passage`` is the best
    document with the node.  A query without a run by a method has one row of it: node ``nobody``, score 0.
    """
    spark = ranked.sparkSession
    given = query_rows(ranked, edge_docs)
    items_type, node_type = given.schema["items"].dataType.simpleString(), edge_docs.schema["node"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _chunks(_whole(batch.column("items"))):
                part = batch.slice(lo, hi - lo)
                q = _Queries(part.column("query_id"), part.column("items"), grid)
                sums = [pa.array(np.bincount(q.query, x, len(part)).astype(np.int64)) for x in (q.joined, q.seeded)]
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("items"), *sums], names=["query_id", "items", "n_nodes", "n_seeds"])

    counted = given.mapInArrow(count, f"query_id string, items {items_type}, n_nodes bigint, n_seeds bigint")
    path, n = store_measuring(counted, "queries", nodes=F.sum("n_nodes"), seeds=F.sum("n_seeds"))
    n_nodes, n_seeds = (len(grid.cells) * (n[k] or 0) for k in ("nodes", "seeds"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _chunks(_whole(batch.column("items"))):
                part = batch.slice(lo, hi - lo)
                for q in _Queries(part.column("query_id"), part.column("items"), grid).parts():
                    yield from best_of(part.column("query_id"), q)

    def best_of(query_id: pa.Array, q: _Queries) -> Iterator[pa.RecordBatch]:
        nodes, passages, at = pa.array(q.nodes), q.passages(), np.flatnonzero(q.joined)
        has = np.zeros(len(query_id) * len(grid.models), bool)
        has[q.group[at]] = True
        empty = np.flatnonzero(q.groups & ~has)
        for graph, weighting, walk, score in q.scores(n_nodes, n_seeds):
            methods = pa.array(["-".join((graph, weighting, walk, m)) for m in grid.models])
            order = at[np.lexsort((q.code[at], -score[at], q.group[at]))]
            place = _places(q.group[order])
            best, place = order[place < grid.depth], place[place < grid.depth]
            group = np.r_[q.group[best], empty]
            columns = [
                methods.take(pa.array(group % len(grid.models))),
                query_id.take(pa.array(group // len(grid.models))),
                pa.concat_arrays([nodes.take(pa.array(q.code[best])), pa.array([nobody] * len(empty), nodes.type)]),
                pa.array(np.r_[score[best], np.zeros(len(empty))]),
                pa.array(np.r_[place + 1, np.ones(len(empty), np.int64)].astype(np.int32)),
                pa.concat_arrays([q.doc.take(pa.array(passages[best])), pa.nulls(len(empty), q.doc.type)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["method", "query_id", "node", "score", "rank", "passage"])

    stored = load(spark, path, counted).select("query_id", "items")
    return stored.mapInArrow(walk, f"method string, query_id string, node {node_type}, score double, rank int, passage string")
