import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellum.llm.scan import prefix_compose, run


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 700), st.integers(1, 9), st.integers(2, 64))
def test_scan_equals_stepping(seed, n, states, chunk):
    rng = np.random.default_rng(seed)
    delta = rng.integers(0, states, (5, states)).astype(np.uint8)
    symbols = rng.integers(0, 5, n).astype(np.uint8)
    at, want = 0, []
    for s in symbols:
        want.append(at)
        at = delta[s, at]
    assert run(symbols, delta, 0, chunk).tolist() == want


def test_prefix_compose_is_associative_order():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 4, (13, 4)).astype(np.uint8)
    out = prefix_compose(f)
    for i in range(13):
        for s in range(4):
            at = s
            for j in range(i + 1):
                at = f[j, at]
            assert out[i, s] == at


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 900), st.integers(1, 45), st.sampled_from([7, 64, 4096]))
def test_pieces_equal_one_long_run(seed, n, states, limit):
    from tessellum.llm import scan

    rng = np.random.default_rng(seed)
    delta = rng.integers(0, states, (6, states)).astype(np.uint8)
    delta[5] = 0  # resets
    symbols = rng.choice(6, n, p=[0.3, 0.2, 0.2, 0.2, 0.08, 0.02]).astype(np.uint8)
    old, scan.LONG_PIECE = scan.LONG_PIECE, limit
    try:
        got = scan.run_pieces(symbols, delta, np.flatnonzero(symbols == 5))
    finally:
        scan.LONG_PIECE = old
    assert got.tolist() == run(symbols, delta).tolist()
