"""The log-structured store against a model, and what a change writes."""

import json
import random

import pytest

from callweave import schema
from callweave.engine import Engine
from callweave.sources.store import SEGMENTS, Manifest, Store, StoreChanged


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.TRIGRAMS)


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def rows_of(store):
    return sorted(tuple(r) for r in store.table("trigrams").collect())


def test_random_changes_against_a_model(spark, tmp_path):
    """Changes that take and bring any keys, many of them, then a compaction; merges happen on the way."""
    rng = random.Random(1)
    store, model = Store(spark, str(tmp_path)), {f"s{i}": {f"g{k}" for k in range(3)} for i in range(60)}
    as_rows = lambda m: [(g, i) for i, grams in m.items() for g in grams]
    store.write({"trigrams": frame(spark, as_rows(model))}, {"k": None})
    longest = 0
    for step in range(14):
        gone = rng.sample([f"s{i}" for i in range(80)], rng.randrange(6))
        new = {f"s{rng.randrange(80)}": {f"n{step}", f"n{rng.randrange(9)}"} for _ in range(rng.randrange(4))}
        gone += list(new)
        store.append({"trigrams": (keys(spark, gone), frame(spark, as_rows(new)))}, {"k": str(step)})
        model = {i: g for i, g in model.items() if i not in gone} | new
        assert rows_of(store) == sorted(as_rows(model))
        longest = max(longest, len(store.manifest.tables["trigrams"]))
    assert 2 < longest <= SEGMENTS and store.manifest.facts == {"k": "13"}
    before = rows_of(store)
    store.compact()
    (only,) = store.manifest.tables["trigrams"]
    assert rows_of(store) == before and only.gone == 0 and only.rows == len(before) == store.counts()["trigrams"]


def test_an_empty_change_writes_no_segment(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write({"trigrams": frame(spark, [("a", "x")])}, {})
    store.append({"trigrams": (keys(spark, []), frame(spark, []))}, {"f": "1"})
    assert len(store.manifest.tables["trigrams"]) == 1 and store.manifest.version == 2
    store.append({"trigrams": (keys(spark, ["x"]), frame(spark, []))}, {})
    assert rows_of(store) == [] and store.table("trigrams").columns == ["gram", "id"]


def test_versions(spark, tmp_path):
    """A reader keeps the version before; older ones go; of two writers one fails and leaves nothing."""
    store = Store(spark, str(tmp_path))
    store.write({"trigrams": frame(spark, [("a", "x")])}, {})
    reader = store.table("trigrams")
    store.write({"trigrams": frame(spark, [("b", "y")])}, {})
    assert [tuple(r) for r in reader.collect()] == [("a", "x")]
    late = store.manifest
    store.write({"trigrams": frame(spark, [("c", "z")])}, {})
    assert sorted(p.name for p in (tmp_path / "manifests").glob("*.json")) == ["0000000002.json", "0000000003.json"]
    assert len(list((tmp_path / "trigrams").glob("seg-*"))) == 2
    with pytest.raises(StoreChanged):
        store._commit(Manifest(3, schema.SCHEMA_VERSION, {}, late.tables), late)
    assert rows_of(store) == [("c", "z")]
    assert json.loads((tmp_path / "manifests/0000000003.json").read_text())["version"] == 3


def put_many(folder, n):
    for k in range(n):
        (folder / f"m{k}.rs").write_text("".join(f"/// doc of {k}\nfn f_{k}_{j}() {{ f_{(k + 1) % n}_{j}(); gone_{k}(); }}\n" for j in range(20)))


def test_a_sync_of_one_file_writes_in_proportion_to_it(spark, tmp_path):
    """About the same bytes whether the workspace has 30 files or 240, few beside a build's; and the tables of a fresh build."""
    wrote = {}
    for n in (30, 240):
        own = tmp_path / str(n)
        own.mkdir()
        put_many(own, n)
        engine = Engine(spark, str(own))
        engine.build()
        built = engine.store.manifest
        (own / "m3.rs").write_text("fn f_3_0() { f_9_1(); }\nfn gone_4() {}\n")
        engine.sync()
        after = engine.store.manifest
        wrote[n] = sum(s.size for t, found in after.tables.items() for s in found if s not in built.tables[t])
    assert wrote[240] < 1.1 * wrote[30]
    assert wrote[240] < 0.1 * sum(s.size for found in built.tables.values() for s in found)
    read = lambda: {t: sorted(tuple(map(repr, r)) for r in engine.table(t).collect()) for t in engine.store.manifest.tables}
    tables = read()
    assert any("m3.rs::gone_4" in r[1] for r in tables["edges"])
    engine.build()
    assert read() == tables
