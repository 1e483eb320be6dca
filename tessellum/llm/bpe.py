"""Encoding with a public byte-level BPE vocabulary.

Pre-tokenisation runs without regular expressions.  Every code point gets a class (letter,
number, blank, other white space, other sign; the apostrophe of a contraction is told by the
two points after it), and a finite automaton over the classes, run by the associative scan of
``scan``, says where a token begins.  Equal slices of a block are found by hashing and merged
once; a cache keeps the ids of slices across blocks.  Merging works on all new slices of a
block together: one row per slice, one vector step per merge.

Defined results
---------------
* The ids of a null text and of an empty text are the empty list.
* Special tokens are never produced; their strings in a text are ordinary text.
* Rows are kept one to one: repeated rows and ids give repeated rows.
* Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .textbatch import Joined, blocks, distinct_slices

# symbols of the automaton
LETTER, NUMBER, SIGN, SHORT, LONG, JOIN, WHITE, LONE, BREAK = range(9)
# states: what came before.  SHORT/LONG: apostrophes of 's 't 'm 'd / 're 've 'll
FRESH, BLANK, IN_LETTERS, IN_NUMBERS, IN_SIGNS, TAIL1, TAIL2, IN_WHITE = range(8)
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_IDS = 4_000_000  # ids kept in the cache of one Python worker
NONE = np.int32(2**31 - 1)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(delta, begins): the next state and whether a token begins, by symbol and state."""
    delta, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for s in range(8):
        tail = s in (TAIL1, TAIL2)
        delta[LETTER, s] = {TAIL2: TAIL1, TAIL1: FRESH}.get(s, IN_LETTERS)
        begins[LETTER, s] = not (tail or s in (BLANK, IN_LETTERS))
        delta[NUMBER, s], begins[NUMBER, s] = IN_NUMBERS, s not in (BLANK, IN_NUMBERS)
        delta[SIGN, s], begins[SIGN, s] = IN_SIGNS, s not in (BLANK, IN_SIGNS)
        for sym, to in ((SHORT, TAIL1), (LONG, TAIL2)):
            joined = s in (BLANK, IN_SIGNS)
            delta[sym, s], begins[sym, s] = IN_SIGNS if joined else to, not joined
        delta[JOIN, s] = BLANK
        delta[WHITE, s], begins[WHITE, s] = IN_WHITE, s != IN_WHITE
        delta[LONE, s] = delta[BREAK, s] = FRESH
    return delta, begins


DELTA, BEGINS = _machine()


@lru_cache(1)
def _classes() -> np.ndarray:
    import unicodedata

    table = np.full(0x110000, SIGN, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = WHITE
    return table


def token_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; ``breaks`` are the positions of the separators between texts."""
    n = len(points)
    sym = _classes()[points]
    sym[breaks] = BREAK
    white = sym == WHITE
    last = white.copy()
    last[:-1] &= (sym[1:] != WHITE) & (sym[1:] != BREAK)
    last[-1:] = False
    at = np.flatnonzero(last)
    sym[at] = np.where(points[at] == 0x20, JOIN, LONE)
    quote = np.flatnonzero((points == 0x27) & (sym == SIGN))
    if len(quote):
        one = np.where(quote + 1 < n, points[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        sym[quote[short]] = SHORT
        sym[quote[long]] = LONG
    state = scan.run(sym, DELTA, FRESH)
    return np.flatnonzero(BEGINS.ravel()[sym.astype(np.int64) * 8 + state])


@dataclass
class Vocabulary:
    byte_ids: np.ndarray  # the id of each byte
    pair_keys: np.ndarray  # hash table of pairs: left << 32 | right, or -1
    pair_rank: np.ndarray
    pair_id: np.ndarray
    whole: dict[bytes, int]
    token_bytes: list[bytes]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        raw = {}
        for token, i in model["vocab"].items():
            if all(c in to_byte for c in token):
                raw[token] = i
        token_bytes = [b""] * (max(raw.values()) + 1)
        for token, i in raw.items():
            token_bytes[i] = bytes(to_byte[c] for c in token)
        byte_ids = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            byte_ids[b] = raw[c]
        size = 1 << 19
        keys, rank, ids = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = raw[a] << 32 | raw[b]
            slot = Vocabulary.slot(key)
            while keys[slot] != -1:
                slot = (slot + 1) & (size - 1)
            keys[slot], rank[slot], ids[slot] = key, r, raw[a + b]
        return Vocabulary(byte_ids, keys, rank, ids, {token_bytes[i]: i for i in raw.values()}, token_bytes)

    @staticmethod
    def slot(key):  # noqa: ANN001, ANN205
        if isinstance(key, int):
            return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 45
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; rank NONE where the pair never merges."""
        key = left.astype(np.int64) << 32 | right
        slot = self.slot(key)
        rank, ids = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        mask = len(self.pair_keys) - 1
        while len(open_):
            held = self.pair_keys[slot[open_]]
            hit = held == key[open_]
            at = open_[hit]
            rank[at], ids[at] = self.pair_rank[slot[at]], self.pair_id[slot[at]]
            open_ = open_[~hit & (held != -1)]
            slot[open_] = (slot[open_] + 1) & mask
        return rank, ids

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, merged as byte-pair encoding does: lowest rank first, leftmost first."""
        out: list[np.ndarray | None] = [None] * len(words)
        order = np.argsort([len(w) for w in words], kind="stable")
        lo = 0
        while lo < len(order):
            shortest = len(words[order[lo]])
            hi = lo
            limit = max(4, shortest + shortest // 4)
            while hi < len(order) and len(words[order[hi]]) <= limit and (hi - lo + 1) * limit <= 4_000_000:
                hi += 1
            hi = max(hi, lo + 1)
            self._merge_rows(words, order[lo:hi], out)
            lo = hi
        return out  # type: ignore[return-value]

    def _merge_rows(self, words: list[bytes], rows: np.ndarray, out: list) -> None:
        size = np.array([len(words[i]) for i in rows])
        width, m = int(size.max()), len(rows)
        if width == 0:
            for i in rows:
                out[i] = np.empty(0, np.int32)
            return
        flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(m, width)
        sym = self.byte_ids[flat]
        col = np.arange(width)
        sym[col[None, :] >= size[:, None]] = -1
        rank = np.full((m, width), NONE, np.int32)
        made = np.zeros((m, width), np.int32)
        if width > 1:
            left, right = sym[:, :-1], sym[:, 1:]
            ok = right >= 0
            rank_ok, made_ok = self.find(left[ok], right[ok])
            rank[:, :-1][ok], made[:, :-1][ok] = rank_ok, made_ok
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (m, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (m, 1))
        final, live = sym.copy(), np.arange(m)
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            going = rank[row, best] != NONE
            if not going.all():
                done = ~going
                final[live[done]] = sym[done]
                if not going.any():
                    break
                live, sym, rank, made, after, before, best = (x[going] for x in (live, sym, rank, made, after, before, best))
                row = np.arange(len(live))
            nxt = after[row, best].astype(np.int64)
            far = after[row, nxt].astype(np.int64)
            prev = before[row, best].astype(np.int64)
            sym[row, best] = made[row, best]
            sym[row, nxt] = -1
            rank[row, nxt] = NONE
            after[row, best] = far
            inner = far < width
            before[row[inner], far[inner]] = best[inner]
            rank[row, best] = NONE
            has_right = inner.copy()
            has_right[inner] = sym[row[inner], far[inner]] >= 0
            r, c = row[has_right], best[has_right]
            rank[r, c], made[r, c] = self.find(sym[r, c], sym[r, far[has_right]])
            has_left = prev >= 0
            r, c = row[has_left], prev[has_left]
            rank[r, c], made[r, c] = self.find(sym[r, c], sym[r, best[has_left]])
        keep = final >= 0
        counts = keep.sum(axis=1)
        parts = np.split(final[keep], np.cumsum(counts)[:-1])
        for i, ids in zip(rows, parts):
            out[i] = ids


class Encoder:
    """Encodes blocks of texts; keeps the ids of slices seen before."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary.read(path)
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.at = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int32)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        for word, ids in zip(words, self.vocabulary.merge(raw)):
            k = len(self.code)
            self.code[word] = k
            if k >= len(self.at):
                self.at, self.count = np.resize(self.at, 2 * k), np.resize(self.count, 2 * k)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
            self.at[k], self.count[k] = self.used, len(ids)
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each text, code point at which each id's slice starts within its text)."""
        batch = Joined(texts)
        n = len(texts)
        start = token_starts(batch.points, batch.stop)
        stop = np.r_[start[1:], len(batch.points)]
        owner = np.searchsorted(batch.stop, start)
        real = start != batch.stop[owner]
        start, stop, owner = start[real], stop[real], owner[real]
        slice_code, first = distinct_slices(batch.points, start, stop)
        words = [batch.joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
        if self.used > CACHE_IDS:
            self._clear()
        new = [w for w in words if w not in self.code]
        if new:
            self._learn(new)
        known = np.fromiter((self.code[w] for w in words), np.int64, len(words))[slice_code] if words else np.empty(0, np.int64)
        size = self.count[known].astype(np.int64)
        ends = np.cumsum(size)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        ids = self.pool[np.repeat(self.at[known], size) + inside]
        per_text = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
        return ids, per_text, np.repeat(start - batch.start[owner], size)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_column(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, ids per row, offsets) of successive blocks of ``texts``."""
    machine = encoder(path)
    for lo, hi in blocks(texts):
        yield lo, hi, *machine.encode(texts.slice(lo, hi - lo))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """(id_col, ids[, offsets]); no shuffle.

    ``offsets``: for each id the code point of its text at which its slice starts.
    """
    path = path or default_path()
    picked = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["row_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, ids, per_text, at in encode_column(texts, path):
                bounds = pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32))
                columns = [batch.column("row_id").slice(lo, hi - lo), pa.ListArray.from_arrays(bounds, pa.array(ids))]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(at.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "offsets"][: len(columns)])

    return picked.mapInArrow(work, f"`{id_col}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else ""))


def decode_ids(ids: list[int] | np.ndarray, path: str | None = None) -> str:
    """The text of ``ids``; a full encoding gives back its text exactly."""
    tokens = encoder(path or default_path()).vocabulary.token_bytes
    return b"".join(tokens[i] for i in ids).decode("utf-8", errors="replace")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, text) from lists of ids; null lists give null texts."""
    path = path or default_path()
    picked = encoded.select(F.col(id_col).alias("row_id"), F.col(ids_col).alias("ids"))
    kind = picked.schema["row_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, path) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    return picked.mapInArrow(work, f"`{id_col}` {kind}, text string")
