import random
from statistics import NormalDist

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessellum.llm import fusion, topn

SCHEMA = "query_id string, entry_item string, entry_score double, entry_method_names array<string>, rank string, lo int"


def entries(spark, data):
    return topn.list_rows(spark.createDataFrame([(*d, "clash", 0) for d in data], SCHEMA))


def best(data, n):
    lists = {}
    for q, item, score, methods in data:
        if item is None or score is None or score != score:
            continue
        for m in set(methods or []) - {None, ""}:
            own = lists.setdefault((q, m), {})
            own[item] = max(own.get(item, score), score)
    return lists, sorted(((q, m, i, s, k + 1) for (q, m), own in lists.items() for k, (i, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n])), key=repr)


def draw(seed, n):
    random.seed(seed)
    return [(random.choice(["q1", "q2", None]), random.choice([None, *"abcdefghij"]), random.choice([None, float("nan"), 0.0, -1.0, 1.0, 2.5, random.random()]), random.choice([None, [], ["m"], ["m", "m"], ["m", "n"], ["", None, "n"]])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "held"), [(1, None), (2, 5)])
def test_top_n_against_brute_force(spark, monkeypatch, seed, held):
    if held:
        monkeypatch.setattr(topn, "HELD", held)
    data = draw(seed, 400)
    got = topn.top_n(entries(spark, data), ["query_id", "method"], "entry_item", "entry_score", 3)
    assert rows(got) == best(data, 3)[1]


def test_top_n_empty(spark):
    assert topn.top_n(entries(spark, []), ["query_id", "method"], "entry_item", "entry_score", 3).count() == 0
    assert topn.top_n(entries(spark, [("q", "a", 1.0, None)]), ["query_id", "method"], "entry_item", "entry_score", 3).count() == 0


def test_normal_quantile(spark):
    points = [1e-12, 1e-6, 0.01, 0.075, 0.3, 0.5, 0.6, 0.925, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in points], "p double").select("p", fusion.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-9 for r in got)


def combined(data):
    lists, _ = best(data, 0)
    total, methods = {}, {}
    for (q, m), own in lists.items():
        methods.setdefault(q, set()).add(m)
        for item, s in own.items():
            less, same = sum(x < s for x in own.values()), sum(x == s for x in own.values())
            z = NormalDist().inv_cdf((less + (same + 1) / 2 - 0.5) / len(own))
            total[q, item] = total.get((q, item), 0.0) + z
    return {k: v / len(methods[k[0]]) for k, v in total.items()}


@pytest.mark.parametrize("long_list", [200_000, 4])
def test_fusion_against_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(fusion, "LONG_LIST", long_list)
    data = draw(7, 300)
    want = combined(data)
    got = {(r["query_id"], r["entry_item"]): r for r in fusion.fuse(entries(spark, data)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k]["score"] - v) < 1e-8 for k, v in want.items())
    for (q, _), r in got.items():
        assert r["rank"] == 1 + sum(round(v, 9) > r["score"] + 1e-10 for (p, _), v in want.items() if p == q)


def test_no_scale_outweighs_and_missing_lists_do_not_lead(spark):
    data = [("q", i, s, ["small"]) for i, s in (("a", 0.3), ("b", 0.2), ("c", 0.1))] + [("q", i, s, ["huge"]) for i, s in (("a", 2e9), ("b", 1e9), ("c", 3e9))] + [("q", i, s, ["third"]) for i, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))]
    assert rows(fusion.leaders(entries(spark, data), least_methods=3, least_items=3)) == [("q", "a")]
    assert fusion.leaders(entries(spark, data), least_methods=4).count() == 0
    assert rows(fusion.leaders(entries(spark, data), weights={"huge": 9.0})) == [("q", "c")]
    assert fusion.fuse(entries(spark, [])).count() == 0
    one = fusion.fuse(entries(spark, [("q", "x", 5.0, ["m"])])).first()
    assert (one["score"], one["rank"]) == (0.0, 1)


def test_packed_ids_come_back(spark):
    ids = ["", "a", "0" * 40, "AB" * 20, "f" * 40, "ü" * 3, "g" * 40]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    assert [r[0] for r in df.select(fusion._unpacked(fusion._packed(F.col("i")))).collect()] == ids
