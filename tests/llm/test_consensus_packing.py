import random
from datetime import datetime, timedelta

import numpy as np
from helpers import rows

from tessellum.llm import consensus, packing

T0 = datetime(2025, 1, 1)
A = "query_id string, paragraph_id string, facet_id string, session_id string, relevance int, time_stamp timestamp, loaded_at timestamp, annotator string"
M = "session_id string, annotator_ids array<string>, run_ids array<string>, time_stamp timestamp"


def frames(spark, labels, sessions):
    a = spark.createDataFrame([(q, p, None, s, g, None if t is None else T0 + timedelta(hours=t), None, "clash") for q, p, s, g, t in labels], A)
    return a, spark.createDataFrame([(s, who, None, None) for s, who in sessions], M)


def test_one_label_a_person(spark):
    labels = [("q", "p", "s1", 1, 1), ("q", "p", "s2", 3, 2), ("q", "p", "s1", 1, 1), ("q", "p", "s3", None, 9), ("q", "p", "s4", 2, None), ("q", "p", "s5", 0, 5), (None, "p", "s1", 0, 5), ("q", "p", "none", 0, 5)]
    sessions = [("s1", [" Ann", "bob"]), ("s1", [" Ann", "bob"]), ("s2", ["ANN "]), ("s3", ["ann"]), ("s4", ["ann", None, " "]), ("s5", []), (None, ["ann"])]
    assert rows(consensus.person_labels(*frames(spark, labels, sessions))) == [("q", "p", "ann", 3), ("q", "p", "bob", 1)]


def test_recovers_truth_better_than_voting(spark):
    rng = random.Random(2)
    grades = [-2, 0, 1, 2, 3]
    skill = {f"a{i}": s for i, s in enumerate([0.95, 0.9, 0.9, 0.85, 0.2, 0.2, 0.2])}  # the last three guess
    labels, truth = [], {}
    for i in range(400):
        truth[f"p{i}"] = t = rng.choice(grades)
        for who in rng.sample(sorted(skill), 4):
            labels.append(("q", f"p{i}", f"s-{who}", t if rng.random() < skill[who] else rng.choice(grades), i))
    a, m = frames(spark, labels, [(f"s-{w}", [w]) for w in skill])
    model = consensus.fit(consensus.person_labels(a, m))
    got = {r["paragraph_id"]: r for r in consensus.consensus(model).collect()}
    right = np.mean([got[p]["relevance"] == t for p, t in truth.items()])
    votes = {}
    for _, p, _, g, _ in labels:
        votes.setdefault(p, []).append(g)
    voted = np.mean([max(sorted(set(v)), key=v.count) == truth[p] for p, v in votes.items()])
    assert right > voted and right > 0.88
    reliability = {r["annotator"]: r for r in consensus.reliability(model).collect()}
    assert min(reliability[f"a{i}"]["reliability"] for i in range(4)) > 0.75 > 0.45 > max(reliability[f"a{i}"]["reliability"] for i in range(4, 7))
    assert all(r["low"] < r["reliability"] < r["high"] for r in reliability.values())


def test_agreement_and_empty(spark):
    labels = [("q", "p1", "s1", 1, 1), ("q", "p1", "s2", 1, 1), ("q", "p2", "s1", 3, 1), ("q", "p2", "s2", 0, 1), ("q", "p3", "s1", 2, 1)]
    people = [("s1", ["x"]), ("s2", ["y"])]
    a, m = frames(spark, labels, people)
    got = {r["paragraph_id"]: r["agreement"] for r in consensus.consensus(consensus.fit(consensus.person_labels(a, m))).collect()}
    assert got["p1"] == 1.0 and got["p2"] < 0 and got["p3"] is None
    a, m = frames(spark, [], [])
    model = consensus.fit(consensus.person_labels(a, m))
    assert consensus.consensus(model).count() == 0 and consensus.reliability(model).count() == 0
    assert tuple(consensus.krippendorff(consensus.person_labels(a, m)).first()) == (0, 0, None)


def test_digamma():
    assert np.allclose(consensus.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721], atol=1e-10)


def test_hilbert_curve_steps_to_neighbours():
    bits = 3
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    index = packing.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    along = points[np.argsort(index)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 7, 50, 99, 100, 101, 250, 333]), rng.randrange(1 << 30)) for i in range(800)] + [(5, 40, 3), (None, 10, 3)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, curve bigint"), 100).collect()
    load, places = {}, {}
    for r in got:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        places.setdefault(r["container_id"], []).append((r["start_in_container"], r["n_tokens"], r["position"]))
    assert max(load.values()) <= 100
    for items in places.values():
        items.sort(key=lambda x: x[2])
        at = 0
        for start, n, _ in items:
            assert start == at
            at += n
        assert [p for _, _, p in items] == list(range(len(items)))
    assert sum(r["n_tokens"] for r in got) == sum(s for _, s, _ in sizes)
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
    assert all(sorted(pieces[i]) == [(0, n)] for i, n, _ in sizes if n <= 100 and i not in (5, None))
    assert all([n for _, n in sorted(pieces[i])] == [100] * (n // 100) + ([n % 100] if n % 100 else []) for i, n, _ in sizes if n > 100 and i not in (5, None))
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint, curve bigint")).count() == 0


def test_sizes_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "Hello world", 7), (3, "Hello world", 7)], "doc_id bigint, text string, n_tokens int")
    assert rows(packing.sized(docs).select("doc_id", "n_tokens")) == [(1, 0), (2, 0), (3, 2), (3, 2)]


def test_a_container_is_filled_exactly_from_the_nearest_neighbours():
    assert packing._fill([60, 50, 30, 0, 10, 40], 100) == ([0, 2, 3, 4], True)
    assert packing._fill([100, 1], 100) == ([0], True)
    assert packing._fill([60, 70, 30], 100) == ([0, 2], False)
    assert packing._fill([0, 0, 5], 100) == ([0, 1, 2], False)
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(0, 40) for _ in range(rng.randint(1, 9))]
        chosen, full = packing._fill(sizes, 60)
        used = sum(sizes[k] for k in chosen)
        reach = {sizes[0]}
        for x in sizes[1:]:
            reach |= {r + x for r in reach if r + x <= 60}
        assert chosen[0] == 0 and len(set(chosen)) == len(chosen) and used == max(reach) and full == (used == 60)


def test_report_of_fill_and_likeness(spark):
    rng = np.random.default_rng(5)
    means = rng.normal(0, 0.15, (6000, 3))
    data = [(i, int(rng.integers(20, 400)), int(k), [float(x) for x in m]) for i, (m, k) in enumerate(zip(means, packing.curve_keys(means)))]
    sizes = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, curve bigint, place array<double>")
    r = packing.report(packing.pack(sizes), sizes).first()
    assert r["n_documents"] == 6000 and r["fill"] > 0.99 and r["alike"] < 0.35
    shuffled = spark.createDataFrame([(i, n, int(rng.integers(1 << 30)), m) for i, n, _, m in data], sizes.schema)
    assert packing.report(packing.pack(shuffled), shuffled).first()["alike"] > 0.9
