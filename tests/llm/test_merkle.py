"""The Merkle manifest against a tree made row by row."""

import hashlib
import random
import zlib
from itertools import count

import pytest
from pyspark.sql import functions as F

from callweave.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Levels from the leaves to the root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    for now in levels[:-1]:
        yield (bool(i & 1), now[i ^ 1] if i ^ 1 < len(now) else None)
        i >>= 1


def brute(rows):
    """rows: (order, group, leaf). A (order, leaf, subroot, root, path) for each."""
    groups = {}
    for o, g, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    return sorted(
        (repr(x[1] if x[0] else None), x[2], trees[g][-1][0], top[-1][0], [*path(trees[g], i), *path(top, k)])
        for k, g in enumerate(names) for i, x in enumerate(sorted(groups[g]))
    )


def made(spark, rows, **names):
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumns({"idx": F.lit("?"), "n": F.lit(1), "payload": F.lit(2), "path": F.lit(3), "grp": F.lit(4)})
    out = merkle.manifest(df.repartition(5)).collect()
    return sorted((repr(r["row"]["doc_id"]), r["leaf"], r["subroot"], r["root"], [(s["on_left"], s["digest"]) for s in r["path"]]) for r in out)


def test_against_a_tree_made_in_order(spark):
    rng = random.Random(4)
    ids = count()
    rows = [(next(ids), lang, h(str(rng.random()))) for lang, n in (("en", 777), ("de", 1), ("é", 2), ("", 3), (None, 64), ("zz", 5)) for _ in range(n)]
    rng.shuffle(rows)
    assert made(spark, rows) == brute(rows)


@pytest.mark.parametrize("span", [1, 3])
def test_many_blocks(spark, monkeypatch, span):
    """Blocks of few leaves, frontiers of several rounds."""
    monkeypatch.setattr(merkle, "RUNS", (2, 5, 9, 62))
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = [(i, "a" if i % 3 else "b", h(str(i))) for i in range(150)] + [(1000, None, h("x"))]
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(merkle)  # so that the workers see the small spans
    try:
        assert made(spark, rows) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(merkle)


def test_odd_rows(spark):
    """Null orders, repeated rows, ties, an empty table, one row."""
    rows = [(None, "a", h("1")), (None, "a", h("2")), (5, "a", h("3")), (5, "a", h("3")), (5, "a", h("0")), (-1, "a", h("9")), (7, None, h("4"))]
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == []
    assert made(spark, [(1, "x", h("a"))]) == [("1", h("a"), h("a"), h("a"), [])]


def test_cells_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_CELLS", 0)
    rows = [(i, "ab"[i % 2], h(str(i))) for i in range(40)]
    assert made(spark, rows) == brute(rows)


def test_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, and what tampering changes."""
    data = [(i, None if i % 5 == 0 else "t" * i, None if i % 4 == 0 else "de", None if i % 3 == 0 else f"s{i}", None if i % 6 == 0 else i) for i in range(40)]
    data += [(99, "ü" * 30_000, "en", "", 7), (100, "", "en", "a:b", -1), (None, "x", "en", "s", 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_merkle(spark, str(tmp_path)).collect()}
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more=0: h(said(r[0]), said(r[3]), said(r[2]), said(r[4] if r[4] is None else r[4] + more), said(r[1]))
    want = {x[1]: x for x in brute([(r[0], r[2], leaf(r)) for r in data])}
    tampered = 0
    for r in data:
        _, own, subroot, root, steps = want[leaf(r)]
        now = own
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
            now, tampered = leaf(r, 1), tampered + 1
        for left, sister in steps:
            now = h(now) if sister is None else h(sister, now) if left else h(now, sister)
        assert tuple(got[r[0]]) == (r[0], own, subroot, root, h(*[s for _, s in steps if s]), now, now == root)
    assert tampered and sum(not r["verified"] for r in got.values()) == tampered
