"""Top N items within every group.

A bounded, mergeable summary per group: its N best distinct items, compared by falling score
and then by the smaller item.  Each partition builds the summaries of its own rows batch by
batch (vectorised) before anything is shuffled; at most N rows per group and partition then
travel, and are merged the same way.  The summary is idempotent and associative, so a
partition with too many groups may hand out what it holds and start afresh, and a hot group
is reduced wherever its rows lie.

Defined results
---------------
* Rows with null item, null or NaN score, or no method do not count; null and empty method
  names are no methods.  A method named twice in a row counts once.
* An item counts once per list, with its highest score; -0.0 equals 0.0.
* A null query is a group of its own.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD = 400_000  # rows held by the summaries of one task before they are handed on


def list_rows(entries: DataFrame) -> DataFrame:
    """(query_id, method, entry_item, entry_score): the rows of every list."""
    kept = entries.where("entry_item IS NOT NULL AND entry_score IS NOT NULL AND NOT isnan(entry_score)")
    methods = F.array_distinct(F.filter("entry_method_names", lambda m: m.isNotNull() & (m != "")))
    score = F.col("entry_score") + F.lit(0.0)  # -0.0 becomes 0.0
    return kept.select("query_id", F.explode(methods).alias("method"), "entry_item", score.alias("entry_score"))


def _codes(table: pa.Table, groups: list[str]) -> np.ndarray:
    """A number for each row's group."""
    code = np.zeros(table.num_rows, np.int64)
    for name in groups:
        idx = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * (idx.max() + 1) + idx
        if code.max() > 1 << 40:
            code = np.unique(code, return_inverse=True)[1]
    return code


def _best(table: pa.Table, groups: list[str], item: str, score: str, n: int) -> pa.Table:
    """The first ``n`` distinct items of each group."""
    if not table.num_rows:
        return table
    code = _codes(table, groups)
    value = table[score].to_numpy()
    order = np.lexsort((-value, code))
    c, v = code[order], value[order]
    keys = table[item].take(pa.array(order)).combine_chunks()
    begins = np.r_[True, c[1:] != c[:-1]]
    tied = np.r_[False, (c[1:] == c[:-1]) & (v[1:] == v[:-1])]
    if tied.any():  # order ties by item; only runs of equal scores are sorted
        run = np.cumsum(~tied) - 1
        size = np.bincount(run)
        at = np.flatnonzero(size[run] > 1)
        text = keys.take(pa.array(at))
        sub = pa.table({"r": run[at], "k": text})
        order[at] = order[at][pc.sort_indices(sub, sort_keys=[("r", "ascending"), ("k", "ascending")]).to_numpy()]
        keys = table[item].take(pa.array(order)).combine_chunks()
    first = np.maximum.accumulate(np.where(begins, np.arange(len(c)), 0))
    place = np.arange(len(c)) - first
    # an item's later rows do not count: drop them among rows that could enter
    item_code = pc.dictionary_encode(keys).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = c * (item_code.max() + 1) + item_code if c.max() < (1 << 62) // (item_code.max() + 1) else None
    if pair is None:
        pair = np.unique(np.stack([c, item_code]), axis=1, return_inverse=True)[1]
    by = np.argsort(pair, kind="stable")
    again = np.zeros(len(c), bool)
    again[by[1:]] = pair[by[1:]] == pair[by[:-1]]
    if again.any():
        dropped = np.cumsum(again)
        base = np.where(first > 0, dropped[np.maximum(first - 1, 0)], 0)
        place = place - (dropped - base)
    keep = ~again & (place < n)
    return table.take(pa.array(order[keep]))


def top_n(rows: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """The groups' best ``n`` items with their score and ``rank``."""
    columns = [*groups, item, score]
    picked = rows.select(*columns)
    schema = picked.schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            part = _best(pa.Table.from_batches([batch]), groups, item, score, n)
            held.append(part)
            size += part.num_rows
            if size > HELD:
                merged = _best(pa.concat_tables(held), groups, item, score, n)
                if merged.num_rows > HELD // 2:
                    yield from merged.to_batches()
                    held, size = [], 0
                else:
                    held, size = [merged], merged.num_rows
        if held:
            yield from _best(pa.concat_tables(held), groups, item, score, n).to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by group; the last group of a batch waits for the next."""
        waiting: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            if not part.num_rows:
                continue
            code = _codes(part, groups)
            open_ = code == code[-1]
            yield from ranked(_best(part.filter(pa.array(~open_)), groups, item, score, n))
            waiting = _best(part.filter(pa.array(open_)), groups, item, score, n)
        if waiting is not None:
            yield from ranked(waiting)

    def ranked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            code = _codes(table, groups)
            begins = np.r_[True, code[1:] != code[:-1]]
            at = np.arange(len(code))
            rank = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
            yield from table.append_column("rank", pa.array(rank.astype(np.int32))).combine_chunks().to_batches()

    summaries = picked.mapInArrow(build, schema)
    together = summaries.repartition(*groups).sortWithinPartitions(*groups)
    return together.mapInArrow(merge, T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
