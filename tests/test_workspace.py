"""The workspace as a data source, point lookups, and an index that follows notices."""

import json
import os

import pytest
from pyspark.sql import functions as F

from callweave import schema
from callweave.engine import Engine
from callweave.operators import lookup
from callweave.sources import scan, workspace
from callweave.sources.store import Store
from callweave.streaming.follow import follow
from tests.test_engine import FILES, put


def rows(df, *columns):
    return sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())


def test_source_gives_what_a_scan_gives(spark, tmp_path):
    put(tmp_path, FILES)
    (tmp_path / "bad.rs").write_bytes(b"fn x\xff() {}")
    for library in (False, True):
        found = workspace.files(spark, str(tmp_path), library)
        want = scan.scan(spark, str(tmp_path), library)
        assert rows(found, *want.columns) == rows(want, *want.columns) and found.count() > 5
    assert workspace.files(spark, str(tmp_path / "go")).columns == [c.split()[0] for c in workspace.SCHEMA.split(", ")]
    os.mkdir(tmp_path / "empty")
    assert workspace.files(spark, str(tmp_path / "empty")).collect() == []


def test_filters_reach_the_list(spark, tmp_path, monkeypatch):
    put(tmp_path, FILES)
    read = lambda *filters: (r := workspace.WorkspaceReader(str(tmp_path), False, 100), list(r.pushFilters(filters)), {f[0] for f in r.listed()})[1:]
    odd = workspace.Filter()
    assert read(workspace.StringStartsWith(("file_path",), "tests/"), odd) == ([odd], {"tests/t.rs"})
    assert read(workspace.EqualTo(("language",), "go")) == ([], {"go/x_test.go"})
    with monkeypatch.context() as m:
        m.setattr(scan, "list_files", lambda *a: 1 / 0)  # named files need no walk
        assert read(workspace.In(("file_path",), ("a.rs", "none.rs", "vendor/v.go", "../a.rs", None)), workspace.EqualTo(("file_path",), "a.rs")) == ([], {"a.rs"})
    found = workspace.files(spark, str(tmp_path)).where(F.col("file_path").isin("a.rs", "b.rs") & (F.length("content") > 60))
    assert [r["file_path"] for r in found.collect()] == ["a.rs"]
    paths = spark.createDataFrame([("a.rs",), ("vendor/v.go",), ("gone.rs",)], "file_path string")
    assert {r["file_path"] for r in workspace.named(spark, str(tmp_path), paths).collect()} == {"a.rs", "vendor/v.go"}
    monkeypatch.setattr(workspace, "NAMED", 1)
    assert {r["file_path"] for r in workspace.named(spark, str(tmp_path), paths).collect()} == {"a.rs", "vendor/v.go"}


def test_files_are_dealt_by_bytes():
    files = [(f"f{k}", "go", size, 0) for k, size in enumerate([1000, 10, 10, 10, 500, 490, 0, 0])]
    parts = workspace.dealt(files, 2)
    assert sorted(f for p in parts for f in p) == sorted(files) and {sum(f[2] for f in p) for p in parts} == {1010}
    assert workspace.dealt(files[:1], 3) == [files[:1]]


def test_callers_of_one_symbol_read_one_file(spark, tmp_path, monkeypatch):
    """Edges lie by target, in ranges: the filter reaches the scan, and one of many files has the symbol."""
    monkeypatch.setattr(lookup, "IDS", 5)
    n = 4000
    names = [F.format_string("f.rs::s%05d", x).alias(c) for c, x in (("source_id", F.col("id") * 7 % n), ("target_id", F.col("id") % 1000))]
    edges = spark.range(4 * n).select(*names, F.lit("calls").alias("kind"), F.lit(5).alias("resolution_kind")).distinct()
    nodes = spark.range(n).select(F.format_string("f.rs::s%05d", "id").alias("id"), F.format_string("s%05d", "id").alias("name"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.NODES.split(", ")[2:]])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = Store(spark, str(tmp_path))
        store.write({"edges": edges, "nodes": nodes}, {})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    target = lookup.find_nodes(store.table("nodes"), name="s00123")
    found = lookup.callers(target, store.table("edges"), store.table("nodes"))
    want = {r["source_id"] for r in edges.where("target_id = 'f.rs::s00123'").collect()}
    assert {r["id"] for r in found.collect()} == want and len(want) > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(target_id,f.rs::s00123)" in plan
    by_file = store.table("edges").groupBy(F.input_file_name().alias("file")).agg(F.min("target_id").alias("a"), F.max("target_id").alias("b")).collect()
    assert len(by_file) > 4 and sum(r["a"] <= "f.rs::s00123" <= r["b"] for r in by_file) == 1
    every = lookup.callers(store.table("nodes"), store.table("edges"), store.table("nodes"))  # too many for a filter: joined
    assert every.count() == edges.select("source_id").distinct().count()


def test_an_index_follows_notices(spark, tmp_path, monkeypatch):
    """Notices of new, changed, unchanged, gone and foreign files, in two runs of the stream, give a fresh build's tables."""
    work, notices = tmp_path / "w", tmp_path / "n"
    put(work, FILES)
    notices.mkdir()
    engine = Engine(spark, str(work))
    engine.build()

    def say(name, *paths):
        (notices / name).write_text("".join(json.dumps({"file_path": p, "why": "x"}) + "\n" for p in paths))

    def run():
        stream = spark.readStream.schema("file_path string, why string").option("maxFilesPerTrigger", 1).json(str(notices))
        query = follow(stream, engine, str(tmp_path / "c"))
        query.awaitTermination(300)
        assert query.exception() is None

    whole = scan.list_files
    monkeypatch.setattr(scan, "list_files", lambda *a: 1 / 0)  # no notice walks the workspace
    put(work, {"b.rs": "fn helper_in_tests() {}\n", "c.rs": "fn target() {}\nfn missing() {}\n"})
    say("1.json", "b.rs", "c.rs", "b.rs", "a.rs", "notes.txt", "vendor/v.go", "no/such.rs")
    run()
    version = engine.store.manifest.version
    os.remove(work / "_x.rs")
    (work / "a.rs").write_bytes(b"fn x\xff() {}")
    say("2.json", "_x.rs", "c.rs", "a.rs")
    say("3.json", "c.rs")
    run()
    assert engine.store.manifest.version == version + 1  # the third batch had nothing new
    got = {t: rows(engine.table(t), "*") for t in engine.store.manifest.tables}
    monkeypatch.setattr(scan, "list_files", whole)
    put(work, {"a.rs": FILES["a.rs"]})
    os.utime(work / "a.rs", (0, [r["last_modified"] for r in engine.table("files").where("file_path = 'a.rs'").collect()][0]))
    engine.build()
    assert {t: rows(engine.table(t), "*") for t in got} == got
    assert any("c.rs::missing" in r[1] for r in got["edges"])


def test_without_an_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path)).sync()
