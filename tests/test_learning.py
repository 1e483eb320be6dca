"""Learning operators on made-up rows."""

import random

import numpy as np
import pytest

from tessellum.operators import learning


def test_svm_grid_reaches_the_least_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 3))
    y = (x @ [1.0, -2.0, 0.0] + rng.normal(0, 0.8, 400) > 0.3).astype(int)
    data = [([float(v) for v in r], int(t), i % 4 == 0) for i, (r, t) in enumerate(zip(x, y))]
    grid = learning.svm_grid(spark.createDataFrame(data, "features array<double>, label int, held boolean"))
    assert len(grid) == 20 and [f for _, f, _ in grid] == sorted((f for _, f, _ in grid), reverse=True) and grid[0][1] > 0.85
    own = np.array([not h for _, _, h in data])
    a, t = np.c_[x, np.ones(400)][own], (2 * y - 1)[own]

    def loss(c, w):
        return 0.5 * (w @ w) + c * (np.maximum(1 - t * (a @ w), 0) ** 2).sum()

    for c, _, w in grid[::4]:
        least = loss(c, np.array(w))
        assert all(least <= loss(c, np.array(w) + rng.normal(0, 0.02, 4)) + 1e-6 for _ in range(50))


def test_coordinate_ascent_finds_the_telling_feature(spark):
    rng = random.Random(5)
    rows_, relevant = [], []
    for q in range(30):
        for d in range(12):
            good = d < 3
            rows_.append((f"q{q}", f"d{q}-{d}", [rng.random() * 5, (1.0 if good else 0.0) + rng.random() * 1.1, 7.0]))
            if good:
                relevant.append((f"q{q}", f"d{q}-{d}"))
    weights, train, test, spread = learning.coordinate_ascent(spark.createDataFrame(rows_, "query_id string, doc_id string, features array<double>"), spark.createDataFrame(relevant, "query_id string, doc_id string"), folds=2)
    assert all(w[1] > 2 * abs(w[0]) for w in weights) and min(train) > 0.9 and min(test) > 0.85
    assert spread[2] == 0 and learning.raw_weights([1.0, 2.0, 3.0], spread)[2] == 0.0


def test_balanced_and_standardised(spark):
    df = spark.createDataFrame([(f"k{i}", int(i % 5 == 0), [float(i), 1.0]) for i in range(50)], "k string, label int, features array<double>")
    assert {r["label"]: r["count"] for r in learning.balanced(df, ["k"]).groupBy("label").count().collect()} == {0: 10, 1: 10}
    assert learning.balanced(df.where("label = 1"), ["k"]).count() == 0
    z, mean, spread = learning.standardised(df)
    v = np.array([r["features"] for r in z.collect()])
    assert np.allclose(v.mean(axis=0), 0) and np.allclose(v.std(axis=0), [1, 0]) and mean == [24.5, 1.0]
    with pytest.raises(ValueError):
        learning.standardised(spark.createDataFrame([([0.0] * 201,)], "features array<double>"))


def test_category_vectors(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "a"), (3, "a")], "id int, category string")
    vectors, words = learning.category_vectors(df, 2)
    assert {r["category"]: r["index"] for r in words.collect()} == {"a": 0, "b": 1}
    assert {r["id"]: r["indices"] for r in vectors.collect()} == {1: [0, 1], 2: [0], 3: [0]}
