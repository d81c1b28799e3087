"""Hard negatives against brute force in Python integers."""

import math

import numpy as np
import pytest

from palisade.llm import hard_negatives


def brute(rows, every=100, positives=5, negatives=5):
    ok = []
    for vec, label, x in rows:
        if vec is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            v = [math.floor(256 * v) for v in x]
            if sum(c * c for c in v) < 1 << 62:
                ok.append((vec, label, v))
    out = []
    for i, (a, la, va) in enumerate(ok):
        if a % every:
            continue
        score = [(sum(p * q for p, q in zip(va, v, strict=True)), vec, j, lb) for j, (vec, lb, v) in enumerate(ok) if j != i and len(v) == len(va)]
        like = sorted(((-s, vec, j) for s, vec, j, lb in score if lb == la))[:positives]
        for s, p, _ in like:
            fits = sorted((-n, vec, j) for n, vec, j, lb in score if lb != la and 80 * -s <= 100 * n <= 100 * -s)[:negatives]
            out += [(a, p, k + 1, vec, -s, -n) for k, (n, vec, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, dim))
    x = (centre[rng.integers(0, 7, n)] + rng.normal(size=(n, dim)) * 0.6) * scale * np.exp(rng.normal(size=(n, 1)))
    x[: n // 4] = x[0]  # a large group of equal vectors
    return [(i, int(rng.integers(0, 4)), v) for i, v in enumerate(x.tolist())]


ODD = [
    (700, None, [1.0] * 8), (None, 1, [1.0] * 8), (800, 1, None), (900, 1, [1.0, None] + [0.0] * 6), (1000, 1, [float("nan")] + [0.0] * 7), (1100, 2, [float("inf")] + [0.0] * 7),
    (1200, 3, [0.0] * 8), (1300, 9, [2.0] * 8), (1400, 2, [1e6] * 8), (1500, 2, [1e300] * 8), (1600, 2, []), (1601, 2, []), (1602, 3, []), (1700, 1, [1.0, 2.0]), (1701, 1, [1.0, 1.5]), (1702, 2, [1.0, 1.9]), (200, 1, [1.0] * 8), (200, 1, [1.0] * 8),
]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("RING", 5), ("BLOCK", 7), ("FIRST", 10), ("ANCHORS", 2), ("SAMPLE", 60)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(1, 640, 8) + ODD
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS row", "'x' AS score", "2 AS rank").repartition(3)
    got = hard_negatives.mine(spark, df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.85, 0.0]), (3, 2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.mine(spark, df).collect())) == brute(rows) != []
    assert hard_negatives.mine(spark, df.limit(0)).count() == 0
    assert hard_negatives.mine(spark, df.where("vec_id > 0")).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 29), 1 << 29, (9, 5)), rng.integers(-(1 << 29), 1 << 29, (7, 5))
    assert hard_negatives.products(a, b).tolist() == [[sum(p * q for p, q in zip(x, y, strict=True)) for y in b.tolist()] for x in a.tolist()]
