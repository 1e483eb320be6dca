import random
from datetime import datetime, timedelta

import pytest
from helpers import rows

from tessellum.operators import references as refs

T0 = datetime(2025, 1, 1)
DAY = lambda n: T0 + timedelta(days=n)


def found(spark, links, parents, text):
    kind = "string" if text else "int"
    p = spark.createDataFrame(parents, f"id {kind}, loaded_at timestamp, deleted_at timestamp, row_id string")
    r = spark.createDataFrame(links, f"link_id bigint, target {kind}, loaded_at timestamp, key int")
    return refs.find_orphans(refs.reference_rows(r, "links", "target", "link_id", text), refs.parent_keys(p, "id", text), text).select("row_id", "reason")


@pytest.mark.parametrize("text", [False, True])
def test_reasons(spark, text):
    k = (lambda x: None if x is None else f"k{x}") if text else (lambda x: x)
    parents = [(k(1), DAY(0), None, "c"), (k(2), DAY(0), DAY(5), "c"), (k(3), DAY(9), None, "c"), (k(3), DAY(8), None, "c"), (k(None), DAY(0), None, "c"), (k(6), None, None, "c")]
    links = [(10, k(1), DAY(1), 0), (11, k(2), DAY(5), 0), (12, k(2), DAY(4), 0), (13, k(3), DAY(7), 0), (14, k(3), DAY(8), 0), (15, k(4), DAY(1), 0), (15, k(4), DAY(1), 0), (16, None, DAY(1), 0), (17, k(4), None, 0), (18, k(2), None, 0), (19, k(6), DAY(1), 0)]
    assert rows(found(spark, links, parents, text)) == [(11, "deleted"), (13, "late"), (15, "missing"), (17, "missing")]


def test_keys_are_compared_as_stored(spark):
    parents = [("a", DAY(0), None, ""), ("a\0", DAY(0), None, ""), ("x" * 100, DAY(0), None, "")]
    links = [(1, "A", DAY(1), 0), (2, "a", DAY(1), 0), (3, "a\0", DAY(1), 0), (4, "a\0\0", DAY(1), 0), (5, "x" * 100, DAY(1), 0), (6, "x" * 101, DAY(1), 0), (7, "", DAY(1), 0), (8, " a", DAY(1), 0)]
    assert rows(found(spark, links, parents, True)) == [(1, "missing"), (4, "missing"), (6, "missing"), (7, "missing"), (8, "missing")]


@pytest.mark.parametrize("text", [False, True])
def test_empty_tables(spark, text):
    one = "q" if text else 7
    assert found(spark, [], [], text).count() == 0
    assert rows(found(spark, [(1, one, DAY(1), 0)], [], text)) == [(1, "missing")]
    assert found(spark, [], [(one, DAY(1), None, "")], text).count() == 0


def test_hot_ranges_are_salted(spark, monkeypatch):
    monkeypatch.setattr(refs, "RANGE_KEYS", 20)
    monkeypatch.setattr(refs, "SALT_ROWS", 25)
    random.seed(1)
    parents = [(i * 2, DAY(random.randint(0, 9)), random.choice([None, DAY(random.randint(0, 9))]), "") for i in range(200)]
    links = [(i, 40 if i % 3 == 0 else random.randint(0, 400), DAY(random.randint(0, 9)), 0) for i in range(900)]
    state = {k: (a, d) for k, a, d, _ in parents}
    want = []
    for i, k, at, _ in links:
        if k not in state:
            want.append((i, "missing"))
        elif state[k][1] is not None and state[k][1] <= at:
            want.append((i, "deleted"))
        elif state[k][0] > at:
            want.append((i, "late"))
    assert rows(found(spark, links, parents, False)) == sorted(want, key=repr)
