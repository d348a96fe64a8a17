"""Top k against all pairs."""

import math
import random

import numpy as np
import pytest

from callweave.operators import vectors

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b), 9)
    out = []
    for i, v in queries:
        found = sorted((-cos(v, w), j) for j, w in rows if j != i and len(w) == len(v))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, queries, k, **more):
    make = lambda x: vectors.usable(spark.createDataFrame([(i, v, 0) for i, v in x], DDL), "vec_id", "embedding")
    out = vectors.top_k(make(queries), make(rows), k, **more)
    assert out.columns == ["query_id", "rank", "id", "similarity"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("block_values", [vectors.BLOCK_VALUES, 400])
def test_against_all_pairs(spark, block_values):
    """One vector has a third of the rows, so that ties are everywhere; queries are rows and strangers."""
    rng = random.Random(1)
    v = lambda: [float(rng.randrange(-4, 5)) or 0.5 for _ in range(5)]
    hot = v()
    rows = [(i, hot if i % 3 == 0 else v()) for i in range(600)]
    queries = rows[::40] + [(-1, v()), (-2, hot)]
    assert found(spark, rows, queries, 7, block_values=block_values) == brute(rows, queries, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, [3.0]), (5, [1e30, 1e30]), (6, [1e-30, 0.0])]
    odd = [(7, None), (8, []), (9, [0.0, 0.0]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [1.0, None]), (None, [1.0, 1.0])]
    assert found(spark, good + odd, good + odd, 3) == brute(good, good, 3)
    assert found(spark, [], good, 3) == [] and found(spark, good, [], 3) == []


def test_bounded_selection():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k = int(rng.integers(1, 30)), int(rng.integers(1, 8))
        scores, ids = rng.integers(0, 4, (3, n)).astype(float), rng.permutation(n)
        got = vectors.best_of(scores.copy(), ids, k)
        for row, places in zip(scores, got, strict=True):
            assert sorted(places.tolist()) == sorted(sorted(range(n), key=lambda x: (-row[x], ids[x]))[:k])
