import random

from helpers import rows

from tessellum.operators import hierarchy

SCHEMA = "id int, title string, parent int, loaded_at timestamp"


def resolved(spark, data, schema=SCHEMA):
    return hierarchy.resolve(hierarchy.latest_nodes(spark.createDataFrame(data, schema)))


def test_paths_depths_roots_and_orphans(spark):
    h = resolved(spark, [(1, " A  b ", None, None), (2, None, 1, None), (3, "C", 2, None), (4, "D", 99, None)])
    got = {r["id"]: (r["depth"], r["root"], r["orphan"], list(r["title_path"])) for r in h.nodes.collect()}
    assert got == {1: (0, 1, False, ["A b"]), 2: (1, 1, False, ["A b", ""]), 3: (2, 1, False, ["A b", "", "C"]), 4: (0, 4, True, ["D"])}
    assert rows(hierarchy.descendants(h.nodes)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert h.unreached.count() == 0


def test_cycles_and_what_hangs_below(spark):
    h = resolved(spark, [(5, "x", 5, None), (1, "a", 3, None), (2, "b", 1, None), (3, "c", 2, None), (4, "tail", 1, None), (9, "tail2", 4, None), (7, "ok", None, None)])
    assert {r["id"] for r in h.nodes.collect()} == {7}
    assert rows(hierarchy.cycles(h.unreached)) == [(1, 1), (1, 2), (1, 3), (5, 5)]


def test_ancestors_at_every_level(spark):
    deep = [(i, "t", i - 1 if i > 1 else None, None) for i in range(1, 41)]
    data = [*deep, (50, "orphan", 99, None), (51, "o", 50, None), (60, "a", 62, None), (61, "b", 60, None), (62, "c", 61, None), (63, "tail", 60, None), (64, "tail2", 63, None), (70, "self", 70, None)]
    parent = {i: p for i, _, p, _ in data}
    want = set()
    for i in parent:
        at, level, seen = parent[i], 1, set()
        while at is not None and at not in seen:
            want.add((i, at, level))
            seen.add(at)
            at, level = parent.get(at), level + 1
    nodes = hierarchy.latest_nodes(spark.createDataFrame(data, SCHEMA))
    assert rows(hierarchy.ancestors(nodes)) == sorted(want, key=repr)
    assert (40, 1, 39) in want and (51, 99, 2) in want and (60, 60, 3) in want


def test_latest_delivery_counts_and_null_ids_do_not(spark):
    from datetime import datetime

    data = [(1, "old", None, datetime(2025, 1, 1)), (1, "new", None, datetime(2025, 2, 1)), (None, "n", 1, None), (1, "new", None, datetime(2025, 2, 1))]
    assert rows(hierarchy.latest_nodes(spark.createDataFrame(data, SCHEMA))) == [(1, None, "new")]


def test_empty_and_clashing_columns(spark):
    h = resolved(spark, [])
    assert h.nodes.count() == 0 and hierarchy.cycles(h.unreached).count() == 0 and hierarchy.descendants(h.nodes).count() == 0
    h = resolved(spark, [(1, "a", None, None, 5, "x", True), (2, "b", 1, None, 6, "y", False)], SCHEMA + ", depth int, root string, done boolean")
    assert {(r["id"], r["depth"]) for r in h.nodes.collect()} == {(1, 0), (2, 1)}


def test_random_forests_against_walking(spark):
    random.seed(4)
    n = 120
    parent = {i: random.choice([None, random.randint(0, n + 5), random.randint(0, n - 1)]) for i in range(n)}
    for i in range(60, 100):  # a deep chain
        parent[i] = i - 1
    h = resolved(spark, [(i, f"t{i}", p, None) for i, p in parent.items()])

    def walk(i):
        seen = []
        while i is not None and i in parent and i not in seen:
            seen.append(i)
            i = parent[i]
        return seen, (i if i in parent else None)

    want, on_cycle = {}, set()
    for i in parent:
        seen, back = walk(i)
        if back is None:
            want[i] = (len(seen) - 1, seen[-1])
        elif back == i:
            on_cycle.add((min(walk(i)[0]), i))
    assert {r["id"]: (r["depth"], r["root"]) for r in h.nodes.collect()} == want
    assert {tuple(r) for r in hierarchy.cycles(h.unreached).collect()} == on_cycle


def test_long_chain_and_flat_page(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("int(id) id", "'t' title", "if(id = 0, null, int(id - 1)) parent", "timestamp(null) loaded_at")
    h = hierarchy.resolve(hierarchy.latest_nodes(chain), paths=False)
    assert h.nodes.selectExpr("count(*)", "max(depth)", "sum(depth)", "max(root)").first()[:] == (n, n - 1, n * (n - 1) // 2, 0)
    flat = spark.range(200_000).selectExpr("int(id) id", "'t' title", "if(id = 0, null, 0) parent", "timestamp(null) loaded_at")
    h = hierarchy.resolve(hierarchy.latest_nodes(flat))
    assert h.nodes.where("depth = 1 AND root = 0 AND size(id_path) = 2").count() == 199_999


def test_long_cycle_with_paths_above_the_levels(spark):
    n = 60
    data = [(i, "t", i - 1 if i else None, None) for i in range(n)]  # a chain, so that bands are needed
    data += [(100 + i, "c", 100 + (i + 1) % 50, None) for i in range(50)] + [(200 + i, "tail", 100 if i == 0 else 199 + i, None) for i in range(30)]
    h = resolved(spark, data)
    assert {r["id"]: len(r["id_path"]) for r in h.nodes.collect()} == {i: i + 1 for i in range(n)}
    assert h.unreached.count() == 80
    assert rows(hierarchy.cycles(h.unreached)) == sorted([(100, 100 + i) for i in range(50)], key=repr)
