"""Graph and similarity operators against plain Python."""

import random

import numpy as np
import pytest
from helpers import rows

from tessellum.operators import dedup, expansion, graph


def edges_of(spark, data):
    return spark.createDataFrame(data, "src string, dst string, weight bigint")


def walk(data, jump, rounds, teleport=0.15):
    nodes = sorted({x for a, b, _ in data for x in (a, b)})
    total = {n: sum(w for a, _, w in data if a == n) for n in nodes}
    score = dict(jump)
    for _ in range(rounds):
        lost = sum(score[n] for n in nodes if not total[n])
        score = {n: teleport * jump[n] + (1 - teleport) * (sum(score[a] * w / total[a] for a, b, w in data if b == n) + lost * jump[n]) for n in nodes}
    return score


@pytest.mark.parametrize("kind", ["even", "seeds", "prior"])
def test_pagerank_against_plain_rounds(spark, kind):
    rng = random.Random(6)
    data = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.randint(1, 4)) for _ in range(25)] + [("n0", "sink", 2)]
    data = [d for d in data if d[0] != d[1]]
    nodes = sorted({x for a, b, _ in data for x in (a, b)})
    e = edges_of(spark, data)
    if kind == "even":
        jump, got = {n: 1 / len(nodes) for n in nodes}, graph.pagerank(e, 6)
    elif kind == "seeds":
        jump, got = {n: 0.5 * (n in ("n0", "n1")) for n in nodes}, graph.pagerank(e, 6, jump=spark.createDataFrame([("n0",), ("n1",), ("elsewhere",)], "node string"))
    else:
        jump, got = {n: 0.3 / len(nodes) + 0.7 * {"n0": 0.75, "n1": 0.25}.get(n, 0) for n in nodes}, graph.pagerank(e, 6, jump=spark.createDataFrame([("n0", 3), ("n1", 1)], "node string, weight int"), even=0.3)
    want = walk(data, jump, 6)
    assert {r["node"]: pytest.approx(r["score"], abs=2e-9) for r in got.collect()} == want


def test_pagerank_stops_when_scores_stay(spark):
    e = edges_of(spark, [("a", "b", 1), ("b", "a", 1)])
    assert rows(graph.pagerank(e, 1000, tolerance=1e-3)) == [("a", 0.5), ("b", 0.5)]
    assert graph.pagerank(e.limit(0)).count() == 0
    assert graph.pagerank(e, jump=spark.createDataFrame([("x",)], "node string")).count() == 0


def test_attribute_jump_is_the_expanded_likeness(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (30, 2))
    data = [(f"n{i}", float(a), float(b), 7.0) for i, (a, b) in enumerate(x)] + [("gap", None, 0.5, 7.0)]
    got = {r["node"]: r["weight"] for r in graph.attribute_jump(spark.createDataFrame(data, "node string, a double, b double, c double"), ["a", "b", "c"]).collect()}
    a = np.array([d[1] if d[1] is not None else x[:, 0].mean() for d in data])
    z = np.stack([(a - x[:, 0].mean()) / x[:, 0].std(), (np.array([d[2] for d in data]) - np.mean([d[2] for d in data])) / np.std([d[2] for d in data])], axis=1)
    dot, own = z @ z.T, np.exp(-(z * z).sum(axis=1) / 3)
    want = (own[:, None] * own[None, :] * (1 + 2 / 3 * dot + (2 / 3 * dot) ** 2 / 2)).sum(axis=1)
    assert np.allclose([got[d[0]] for d in data], want)
    exact = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / 3).sum(axis=1)
    assert np.corrcoef(want, exact)[0, 1] > 0.9


def test_distances_have_no_limit(spark):
    chain = edges_of(spark, [(f"c{i:02d}", f"c{i + 1:02d}", 1) for i in range(30)] + [("x", "y", 1)])
    d = graph.distances(chain, spark.createDataFrame([("c00",)], "node string"))
    assert d.where("node = 'c30'").first()["dist"] == 30 and d.count() == 31
    hist = graph.distance_histogram(d, spark.createDataFrame([(33,)], "n bigint"))
    assert {(20, 1), (21, 10), (22, 2)} <= set(rows(hist))
    assert graph.distances(chain, spark.createDataFrame([("c00",)], "node string"), 3).count() == 4


def test_similar_vectors_recall(spark):
    """Against all pairs; noisy copies around the threshold."""
    rng = np.random.default_rng(4)
    base = rng.normal(0.5, 1, (500, 24))
    near = base + rng.normal(0, 0.35, base.shape) * rng.uniform(0.5, 1.6, (500, 1))
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None)], "id int, v array<double>")
    got = {(r["a"], r["b"]) for r in dedup.similar_vectors(frame(base), frame(near), "id", "v", 0.9).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set(zip(*(x.tolist() for x in np.nonzero(unit(base) @ unit(near).T >= 0.9))))
    assert got <= want and len(want) > 200 and len(got) >= 0.99 * len(want)


def test_prefix_filter_equals_all_pairs(spark):
    rng = random.Random(9)
    data = []
    for i in range(60):
        s = rng.sample([f"g{k}" for k in range(40)], rng.randint(1, 8))
        data += [(f"a{i:02d}", s), (f"b{i:02d}", s[: max(1, len(s) - 1)])]
    keyed = dedup.keyed_sets(spark.createDataFrame(data, "id string, items array<string>"), "id", "items")
    sets = dedup.class_sets(keyed)
    for t in (0.4, 0.8):
        assert rows(dedup.similar_sets(sets, "id", "set", t)) == rows(dedup.all_pairs_above(sets, "id", "set", t))
    with pytest.raises(ValueError):
        dedup.all_pairs_above(sets, "id", "set", 0.5, most=10)


def test_toy_paragraphs(spark):
    data = [("test-1", "love hate love hate"), ("test-2", "love hate love love"), ("test-3", "love chip date love"), ("test-4", "chip date love love")]
    from pyspark.sql import functions as F

    from tessellum.functions import text

    sets = spark.createDataFrame(data, "id string, t string").select("id", text.bigram_set(F.col("t")).alias("set"))
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in dedup.similar_sets(sets, "id", "set", 0.1).collect()}
    assert got == {("test-1", "test-2"): 0.666667, ("test-3", "test-4"): 0.5, ("test-2", "test-4"): 0.2}


def test_pairs_of_copies_come_out(spark, tmp_path):
    """Every two copies, all members of linked classes, and pairs right at the distance."""
    from datetime import datetime

    from tessellum.plans import graphs

    line = "a b c d e f"  # five word pairs
    texts = {f"c{i}": line for i in range(7)} | {f"n{i}": line + " f" for i in range(3)} | {"at": "a b c d e", "far": "p q r s", "none": "word"}
    now = datetime(2025, 1, 1)
    spark.createDataFrame([(k, v, now, None) for k, v in texts.items()], "id string, content string, loaded_at timestamp, deleted_at timestamp").write.parquet(f"{tmp_path}/paragraphs.parquet")
    sets = {k: set(zip(v.split(), v.split()[1:])) for k, v in texts.items()}
    want = []
    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both and 5 * both >= 4 * either:
                want.append((a, b, round(1 - both / either, 6)))
    assert len(want) == 21 + 3 + 7 * 3 + 7
    assert rows(graphs.minhash_approx(spark, str(tmp_path))) == sorted(want, key=repr)


def test_member_pairs_in_any_blocks(spark):
    data = [(f"x{i:02d}", ["p", "q"]) for i in range(9)] + [(f"y{i}", ["p", "q", "r"]) for i in range(4)] + [("z", ["s"])]
    keyed = dedup.keyed_sets(spark.createDataFrame(data, "id string, items array<string>"), "id", "items")
    link = spark.createDataFrame([("x00", "y0", 0.5)], "a string, b string, similarity double")
    ids = [d[0] for d in data[:-1]]
    want = sorted(((a, b, 1.0 if a[0] == b[0] else 0.5) for a in ids for b in ids if a < b), key=repr)
    for block in (1, 2, 256):
        assert rows(dedup.member_pairs(link, keyed, block)) == want


def plain_runs(ranked, docs, grid):
    """The runs of ``expansion.method_runs`` for queries that have graphs, cell by cell."""
    nodes_of = lambda doc: [n for d, n in docs if d == doc]
    seen = {}
    for m, q, d, _ in ranked:
        for n in nodes_of(d) if m == grid.seed_model else []:
            seen[q, n] = seen.get((q, n), 0) + 1
    seeds = {(q, n) for q in {q for _, q, _, _ in ranked} for n in sorted((n for p, n in seen if p == q), key=lambda n: (-seen[q, n], n is None, n))[: grid.seeds]}
    edges, found = {}, {}
    for m, q, d, r in ranked:
        for a in nodes_of(d):
            found[m, q, a] = min(found.get((m, q, a), (r, d)), (r, d))
            for b in nodes_of(d):
                if q is not None and a is not None and b is not None and a != b:
                    for k, add in (("count", 1.0), ("reciprocal", 1 / r)):
                        e = edges.setdefault((k, m, q, a), {})
                        e[b] = e.get(b, 0) + add
    flat = {}
    for g, most in grid.filters.items():
        for (k, m, q, a), out in edges.items():
            flat[g, k, m, q, a] = dict(sorted(((b, round(w, 12)) for b, w in out.items()), key=lambda x: (-x[1], x[0]))[:most])
    nodes = sorted(flat)
    jumps = {"pagerank": {x: 1 / len(nodes) for x in nodes}, "personal": {x: float((x[3], x[4]) in seeds) for x in nodes}}
    n_seeds = sum(jumps["personal"].values())
    jumps["personal"] = {x: v / n_seeds for x, v in jumps["personal"].items()}
    out = []
    for walk in grid.walks:
        if walk == "margin":
            score = {x: sum(flat[x].values()) for x in nodes}
        else:
            score = jump = jumps[walk]
            for _ in range(grid.rounds):
                flow = dict.fromkeys(nodes, 0.0)
                for x in nodes:
                    for b, w in flat[x].items():
                        flow[*x[:4], b] += score[x] * w / sum(flat[x].values())
                score = {x: grid.teleport * jump[x] + (1 - grid.teleport) * flow[x] for x in nodes}
        for cell in {x[:4] for x in nodes}:
            own = {x[4]: score[x] for x in nodes if x[:4] == cell}
            share = {n: round(s / sum(own.values()), 9) if sum(own.values()) else 0.0 for n, s in own.items()}
            g, k, m, q = cell
            for i, n in enumerate(sorted(share, key=lambda n: (-share[n], n))[: grid.depth]):
                out.append((f"{g}-{k}-{walk}-{m}", q, n, pytest.approx(share[n], abs=2e-9), i + 1, found[m, q, n][1]))
    return out


@pytest.mark.parametrize("chunk", [1, 40, 1_000_000])
def test_method_runs_against_plain_walks(spark, chunk, monkeypatch):
    """Graphs of all queries side by side; null nodes count for seeds, after others; null queries and those without edges have dummy rows."""
    monkeypatch.setattr(expansion, "CHUNK_PAIRS", chunk)
    rng = random.Random(3)
    docs = sorted({(f"d{i:02d}", rng.choice([None, *range(-3, 9)])) for i in range(30) for _ in range(rng.randrange(6))}, key=repr) + [("one", 5)]
    ranked = [(m, q, d, r + 1) for m in ("x", "y") for q in ("q1", "q2", "q3", "q4", None) for r, d in enumerate(rng.sample([f"d{i:02d}" for i in range(30)], 6))]
    ranked += [("x", "lone", "one", 1), ("y", "gone", "no such", 1)]
    grid = expansion.Grid({"full": None, "top2": 2}, ["pagerank", "personal", "margin"], ["x", "y"], "x", 3, 4, 0.15, 7)
    frames = spark.createDataFrame(ranked, "model string, query_id string, doc string, rank int"), spark.createDataFrame(docs, "doc string, node int")
    got = [tuple(r) for r in expansion.method_runs(*frames, grid, -99).collect()]
    key = lambda r: (r[0], r[1], r[4])
    real, want = sorted((r for r in got if r[2] != -99), key=key), sorted(plain_runs(ranked, docs, grid), key=key)
    assert len(want) > 150 and real == want
    dummies = [r for r in got if r[2] == -99]
    assert len(dummies) == 3 * 24 and {r[2:] for r in dummies} == {(-99, 0.0, 1, None)} and {r[1] for r in dummies} == {"lone", "gone", None}


def test_walks_of_the_grid_write_no_table_a_round(spark, monkeypatch):
    from helpers import SMALL

    from tessellum import storage
    from tessellum.plans import graphs

    stored, store = [], storage.store
    monkeypatch.setattr(storage, "store", lambda df, name="table": stored.append(name) or store(df, name))
    assert graphs.graph_method_runs(spark, SMALL).count() > 0
    assert len(stored) <= 2


def test_similar_sets_orders_members_once(spark):
    """The prefixes are stored before they meet themselves, so the plan of the pairs explodes no set; ids need not follow the rows."""
    data = [(f"s{i:02d}", [f"g{k}" for k in range(i % 7, i % 7 + 5)] + ["common"]) for i in range(30, 0, -1)]
    sets = dedup.class_sets(dedup.keyed_sets(spark.createDataFrame(data, "id string, items array<string>"), "id", "items"))
    got = dedup.similar_sets(sets, "id", "set", 0.5)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == rows(dedup.all_pairs_above(sets, "id", "set", 0.5)) and got.count() == 6
