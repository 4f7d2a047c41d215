"""Exact search against all pairs in Python's whole numbers."""

import math

import numpy as np

from quillseek.llm import pivots

VECTORS = "vec_id long, embedding array<float>, label int"
LONG = (1 << 63) - 1


def brute(rows, config):
    kept = {}
    for vec_id, vector, *_ in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept[vec_id, tuple(math.floor(config.scale * float(np.float32(x))) for x in vector)] = True
    out = []
    for q in kept:
        if q[0] % config.every:
            continue
        scores = [
            (-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q[1], x[1])))), x[0]) for x in kept if x != q and len(x[1]) == len(q[1])
        ]
        out += [(q[0], n, vec_id, -score) for n, (score, vec_id) in enumerate(sorted(scores)[: config.nearest], 1)]
    return sorted(out)


def found(spark, rows, config, schema=VECTORS):
    answers, compared = pivots.highest_products(spark.createDataFrame(rows, schema), config)
    assert answers.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, answers.collect())), dict(compared.collect())


SMALL = pivots.PivotConfig(pivots=6, sample=40, rows=50, queries=4, step=8, every=10)


def test_products_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=12) * 0.2).astype(np.float32).tolist(), 0) for i in range(600)]
    rows += [(i, rng.integers(-1, 2, 12).astype(float).tolist(), 0) for i in range(600, 700)]  # ties
    answers, compared = found(spark, rows, SMALL)
    assert answers == brute(rows, SMALL)
    # Rows lie in groups, and the bounds spare most of them.
    assert sum(compared.values()) < 0.5 * len(compared) * len(rows)


def test_products_of_copies(spark):
    """A third of all rows hold one vector."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, -1.0] if i % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist(), 0) for i in range(400)]
    assert found(spark, rows + rows[:50], SMALL)[0] == brute(rows, SMALL)


def test_products_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [1.0, 1.0], 0), (0, None, 0), (10, [nan, 1.0], 0), (20, [inf, 1.0], 0), (30, [None, 1.0], 0), (40, [], 0), (50, [], 0),
        (60, [0.0, 0.0], 0), (61, [-0.0, 0.0], 0), (70, [1e30, -1e30], 0), (71, [1e30, 1e30], 0), (72, [-3e38, 3e38], 0), (80, [1.0, 2.0], 0), (80, [2.0, 1.0], 0),
        (90, [0.001, -0.001], 0), (91, [5e7, 5e7], 0), (92, [5e7, 4e7], 0), (100, [3e9, 3e9], 0), (110, [1.0, 2.0, 3.0], 0),
    ]
    assert found(spark, rows, SMALL)[0] == brute(rows, SMALL)
    wide = [(i, v, n, "x", 1.0, 2, True) for i, v, n in rows]
    clashing = VECTORS + ", vector string, score double, part int, own boolean"
    assert found(spark, wide, SMALL, clashing)[0] == brute(rows, SMALL)


def test_products_of_nothing(spark):
    assert found(spark, [], SMALL) == ([], {})
    assert found(spark, [(0, [1.0], 0)], SMALL)[0] == []
    assert found(spark, [(0, [1.0], 0), (1, [2.0], 0)], SMALL)[0] == [(0, 1, 1, 256 * 512)]


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for size in (1.0, 1e4, 1e9):
        rows = np.floor(rng.normal(size=(300, 5)) * size)
        table = pivots.distances(rows, pivots.chosen_pivots(rows[:50], 8))
        norms = (rows**2).sum(axis=1)
        for i in range(0, 300, 50):
            gap = pivots.least_gap(table, table, table[i], table[i])
            assert (pivots._bound(norms[i], norms, gap) >= rows @ rows[i]).all()
