"""Hard negatives against all products, with ties, hot vectors and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import negatives as own


def plain(rows, step, k=5, low=80, high=100):
    kept = {}
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            r = (label, [math.floor(256 * x) for x in v])
            kept[vec_id] = min(kept.get(vec_id, r), r)
    dot = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, (label, v) in kept.items():
        if a % step:
            continue
        scored = sorted(((-dot(v, w), b, other == label) for b, (other, w) in kept.items() if b != a))
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fits = [(-t, b) for t, b, same in scored if not same and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, i + 1, b, -s, t) for i, (t, b) in enumerate(fits[:k])]
    return sorted(out)


def mined(spark, rows, step):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, label long, score double").repartition(4)
    return sorted(tuple(r) for r in own.mine(own.prepared(df), F.col("vec_id") % step == 0).collect())


def test_clusters_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(own, "PART", 100)
    monkeypatch.setattr(own, "ROWS", 32)
    monkeypatch.setattr(own, "ANCHORS", 17)  # several blocks
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(6, size=500)] + rng.normal(size=(500, 8)) * 0.2
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[rng.random(500) < 0.3] = v[0]
    v = v.round(1)  # many equal products
    rows = [(k, x.tolist(), int(rng.integers(3))) for k, x in enumerate(v)]
    assert mined(spark, rows, 7) == plain(rows, 7)


def test_odd_rows(spark):
    rng = random.Random(5)
    some = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(k, some(), k % 2) for k in range(60)]
    rows += [(None, some(), 1), (100, None, 1), (101, some(), None), (102, [None, 1.0, 0.0, 0.0], 1), (103, [float("nan"), 0.0, 0.0, 0.0], 0), (104, [float("inf"), 0.0, 0.0, 0.0], 0)]
    rows += [(105, [0.0] * 4, 1), (106, [1.0], 0), (107, [], 1), (3, rows[3][1], 1), (4, rows[5][1], 0), (110, [-0.5, 0.25], 0)]
    assert mined(spark, rows, 5) == plain(rows, 5)


@pytest.mark.parametrize("scale", [1e7, 1e200, 1e-9, 0.0])
def test_sizes_of_numbers(spark, scale):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) * scale for _ in range(3)], k % 3) for k in range(40)]
    assert mined(spark, rows, 4) == plain(rows, 4)


def test_few_rows(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, [1.0], 1)], 1) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 1) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], 1) == plain([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], 1)


def test_radii_certify(spark):
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(300, 5)))
    square = float((x**2).sum(1).max())
    full = own._augmented(x, square)
    d, s = own._distances(own._augmented(x, square), full), x @ x.T
    # the anchor's augmented place is its own: what has a score lies within its radius, and keys differ by no more
    assert (d <= own.radius(s, square)).all()
    pivots = own._pivots(full, 8)
    keys = own._distances(full, pivots)
    assert (np.abs(keys[:, None, :] - keys[None, :, :]).max(2) <= own.radius(s, square)).all()
