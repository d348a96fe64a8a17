"""Substring lookup by trigrams against the comparison of every symbol."""

import random

import pytest

from callweave import schema
from callweave.operators import lookup, trigrams
from callweave.sources.store import Store


@pytest.fixture(scope="module")
def symbols(spark):
    rng = random.Random(1)
    part = lambda: "".join(rng.choice("abAB_é%\\:") for _ in range(rng.randrange(1, 7)))
    rows = []
    for k in range(400):
        name, q = part(), f"{part()}::{part()}"
        rows.append((f"{part()}.rs::{q}{k}", name, "function", None if k % 7 == 0 else q, "f.rs", 1, 1, 0, 0, "", None, False))
    return spark.createDataFrame(rows, schema.NODES).cache()


def test_patterns(spark, symbols, monkeypatch):
    """With wildcards, short runs, letters that fold and others that don't, and none that fit."""
    index = trigrams.index_rows(symbols).cache()
    rng = random.Random(2)
    patterns = ["", "a", "ab", "ABa", "%", "_", "a_b%aa", "é_ab", "ÉAB", "::", "b::a", ".rs::", "zzz", "ab%zzzz", "\\\\a", "rs%::"]
    patterns += ["".join(rng.choice("abAB_%é:") for _ in range(rng.randrange(2, 6))) for _ in range(25)]
    some = 0
    for limit in (trigrams.IDS, 0):
        monkeypatch.setattr(trigrams, "IDS", limit)
        for p in patterns if limit else patterns[:16]:
            want = sorted(r["id"] for r in lookup.find_like(symbols, p).collect())
            assert sorted(r["id"] for r in trigrams.find_like_indexed(symbols, index, p).collect()) == want, p
            some += bool(want and trigrams.literal_grams(p))
    assert some > 10


def test_only_ascii_folds(spark, symbols):
    rows = spark.createDataFrame([("1", "Éa", None), ("2", "éA", None), ("3", "x", "éa")], "id string, name string, qualified_name string")
    assert {r["id"] for r in lookup.find_like(rows, "ÉA").collect()} == {"1"} and {r["id"] for r in lookup.find_like(rows, "éa").collect()} == {"2", "3"}


def test_the_scan_is_told_the_ids(spark, symbols, tmp_path):
    """What reads the symbols has the candidates' ids as a pushed filter, and the index's scan the trigrams."""
    store = Store(spark, str(tmp_path))
    store.write({"nodes": symbols, "trigrams": trigrams.index_rows(symbols)}, {})
    name = symbols.first()["id"]
    found = trigrams.find_like_indexed(store.table("nodes"), store.table("trigrams"), name.replace("%", "_"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and ("EqualTo(id" in plan or "In(id" in plan)
    assert name in {r["id"] for r in found.collect()}
