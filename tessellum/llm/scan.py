"""Finite automata over long symbol arrays by associative composition.

A symbol maps every state to a state, so a stretch of text is a function from states to
states, and stretches compose associatively.  The array is cut into equal chunks; the
functions of all chunks are built side by side (one vector step per position of a chunk),
composed by a parallel prefix scan (Hillis-Steele doubling), and with its entry state known
each chunk is replayed, again side by side.  The work is linear in the text and no step runs
per character in Python.
"""

from __future__ import annotations

import numpy as np

CHUNK = 256


def prefix_compose(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of ``functions`` (n, states): row i maps a start state through rows 0..i."""
    out, step = functions.copy(), 1
    while step < len(out):
        # row i: first what precedes it (row i - step), then itself
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


def run(symbols: np.ndarray, delta: np.ndarray, start: int = 0, chunk: int = CHUNK) -> np.ndarray:
    """The state before each symbol.  ``delta``: (symbols, states) -> state, as uint8."""
    n, states = len(symbols), delta.shape[1]
    if not n:
        return np.empty(0, np.uint8)
    rows = -(-n // chunk)
    grid = np.zeros(rows * chunk, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)  # one row per position of a chunk
    flat = delta.astype(np.uint8).ravel()
    width = np.intp(states)
    now = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    if rows > 1:
        for col in grid:
            now = flat[(col.astype(np.intp) * width)[:, None] + now]
        entry = np.full(rows, start, np.uint8)
        entry[1:] = prefix_compose(now)[:-1, start]
    else:
        entry = np.full(1, start, np.uint8)
    seen = np.empty((chunk, rows), np.uint8)
    at = entry
    for i, col in enumerate(grid):
        seen[i] = at
        at = flat[col.astype(np.intp) * width + at]
    return seen.T.reshape(-1)[:n]


LONG_PIECE = 4096


def run_pieces(symbols: np.ndarray, delta: np.ndarray, resets: np.ndarray, start: int = 0) -> np.ndarray:
    """As ``run``, where every symbol at ``resets`` (sorted) leads to ``start`` from any state.

    The pieces behind them run side by side, each from ``start``; only pieces of more than
    ``LONG_PIECE`` symbols need the functions of chunks.
    """
    n, states = len(symbols), delta.shape[1]
    begins = np.r_[0, resets + 1]
    size = np.diff(np.r_[begins, n])
    out = np.empty(n, np.uint8)
    for i in np.flatnonzero(size > LONG_PIECE):
        out[begins[i] : begins[i] + size[i]] = run(symbols[begins[i] : begins[i] + size[i]], delta, start)
    order = np.argsort(-size, kind="stable")
    order = order[(size[order] <= LONG_PIECE) & (size[order] > 0)]
    at, size = begins[order], size[order]
    if not len(at):
        return out
    flat, width = delta.astype(np.uint8).ravel(), np.intp(states)
    now = np.full(len(at), start, np.uint8)
    # how many pieces (the longest first) have more than k symbols
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    for k, m in enumerate(alive.tolist()):
        place = at[:m] + k
        now = now[:m]
        out[place] = now
        now = flat[symbols[place].astype(np.intp) * width + now]
    return out
