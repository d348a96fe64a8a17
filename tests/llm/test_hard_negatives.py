"""Ball trees against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import hard_negatives as hn

DDL = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, negatives=3, low=50, high=95, every=50):
    """rows: (vec_id, label, whole components)."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a in rows:
        if a[0] % every:
            continue
        others = [(score(a[2], b[2]), b) for b in rows if b[0] != a[0] and len(b[2]) == len(a[2])]
        others.sort(key=lambda x: (-x[0], x[1][0]))
        for p, pos in [x for x in others if x[1][1] == a[1]][:positives]:
            fit = [x for x in others if x[1][1] != a[1] and low * p <= 100 * x[0] <= high * p][:negatives]
            out += [(a[0], pos[0], k, neg[0], p, n) for k, (n, neg) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=50, **more):
    df = hn.usable(spark.createDataFrame(rows, DDL))
    out = hn.mine(df, F.col("vec_id") % every == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def whole(rows):
    return [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows]


@pytest.mark.parametrize("part_values", [hn.PART_VALUES, 900])
def test_against_all_pairs(spark, part_values):
    """Clusters, copies of one vector (a third of the rows), ties and lone labels."""
    rng = random.Random(3)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(900):
        c = rng.randrange(5)
        v = centers[0] if i % 3 == 0 else [x + rng.gauss(0, 0.4) for x in centers[c]]
        rows.append((i, rng.choice([c, c, 7]) if i else 99, v))
    assert mined(spark, rows, every=30, part_values=part_values) == brute(whole(rows), every=30)


def test_odd_rows(spark):
    """Nulls, infinities, other lengths, empty vectors, repeated rows and ids."""
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.0]), (2, 2, [0.6, 0.2]), (3, 2, [0.7, 0.0]), (4, 2, [0.7, 0.0]), (5, 3, [0.9, 0.1]), (-50, 2, [1.0, 1.0]), (6, 2, [1.0]), (50, 4, []), (7, 4, []), (8, 5, [])]
    odd = [(9, None, [1.0, 1.0]), (10, 1, None), (11, 1, [1.0, None]), (12, 2, [nan, 1.0]), (13, 2, [inf, 1.0]), (14, 2, [-inf, 0.0]), (None, 2, [0.7, 0.1])]
    again = [(3, 2, [0.7, 0.0]), (3, 5, [9.0, 9.0])]
    assert mined(spark, good + odd + again) == brute(whole(good))
    assert mined(spark, []) == []
    assert mined(spark, odd) == []
    df = spark.createDataFrame(good, DDL).withColumns({"part": F.lit(1), "kind": F.lit(2), "positives": F.lit("x"), "score": F.lit(0)})
    assert sorted(tuple(r) for r in hn.mine(hn.usable(df), F.col("vec_id") % 50 == 0).collect()) == brute(whole(good))


def test_large_components(spark):
    """Sums beyond what float64 holds exactly."""
    big = float(2**22)
    rows = [(0, 1, [big, big, 1.0]), (1, 1, [big, big, 3.0]), (2, 1, [big, big, 2.0]), (3, 2, [big, big / 2, 1.0]), (4, 2, [big, big / 2, 5.0]), (5, 2, [big, big / 2, 3.0])]
    assert mined(spark, rows) == brute(whole(rows))
    huge = [(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [8e29])]
    assert all(abs(r[4]) <= 2**63 for r in mined(spark, huge))


def test_bounds_leave_nodes_out():
    """A window far from all scores reads no leaf, and clusters are left out for the best in one."""
    rng = np.random.default_rng(5)
    points = np.floor(256 * np.concatenate([rng.normal(size=(500, 8)) * 0.05 + c for c in rng.normal(size=(40, 8))]))
    ids, labels = np.arange(len(points)), np.arange(len(points)) % 3
    tree = hn.BallTree(ids, labels, points)
    read = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key)
            return super().__getitem__(key)

    tree.points = tree.points.view(Counting)
    one = lambda x: np.array([[float(x)]])
    tree.search(points[:1], labels[:1], ids[:1], False, one(1e9), one(2e9), 3)
    assert not read
    scores, found = tree.search(points[:1], labels[:1], ids[:1], True, one(-np.inf), one(np.inf), 5)
    assert len(read) < len([k for k in tree.kids if k[0] < 0]) / 2
    every = [(-(points[0] @ p), i) for i, p in enumerate(points) if labels[i] == labels[0] and i]
    assert [i for _, i in sorted(every)[:5]] == found[0, 0].tolist()
