"""A workspace is built, asked, changed and synced."""

import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from callweave import schema
from callweave.engine import Engine
from callweave.operators import report, resolve, search
from callweave.sources import scan
from callweave.sources.store import IndexMissing

FILES = {
    "a.rs": "fn caller() { target(); missing(); }\nfn other() { caller(); }\n",
    "b.rs": "/// a magic helper\nfn target() { }\nfn helper_in_tests() {}\n",
    "_x.rs": "fn hidden() {}\n",
    ".y.rs": "fn dotted() {}\n",
    "tests/t.rs": "fn test_it() { target(); }\n",
    "src/test/java/T.java": "class T { void m() { } }\n",
    "go/x_test.go": "package x\nfunc TestX() { helper() }\nfunc helper() {}\n",
    "vendor/v.go": "package v\nfunc V() {}\n",
    "target/z.rs": "fn z() {}\n",
    ".git/g.rs": "fn g() {}\n",
    "notes.txt": "fn no() {}\n",
}


def put(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def edges(engine):
    return {(r["source_id"], r["target_id"], r["resolution_kind"]) for r in engine.table("edges").collect()}


def unresolved(engine):
    return {(r["source_id"], r["specifier"]) for r in engine.table("unresolved_refs").collect()}


def test_build_ask_sync(spark, tmp_path):
    put(tmp_path, FILES)
    (tmp_path / "bad.rs").write_bytes(b"fn x\xff() {}")
    engine = Engine(spark, str(tmp_path))
    with pytest.raises(IndexMissing):
        engine.files()
    engine.build()
    files = {r["file_path"]: r for r in engine.files().collect()}
    assert set(files) == {"a.rs", "b.rs", "_x.rs", ".y.rs", "tests/t.rs", "src/test/java/T.java", "go/x_test.go"}
    assert {p for p, r in files.items() if r["is_test"]} == {"tests/t.rs", "src/test/java/T.java", "go/x_test.go"}
    assert ("a.rs::caller", "b.rs::target", 0) in edges(engine) and ("a.rs::other", "a.rs::caller", 1) in edges(engine)
    assert unresolved(engine) == {("a.rs::caller", "missing")}
    assert [r["id"] for r in engine.search("magic").collect()] == ["b.rs::target"]
    assert [r["id"] for r in engine.search("helper").collect()] == ["go/x_test.go::helper", "b.rs::helper_in_tests", "b.rs::target"]
    assert [r["id"] for r in engine.search("helper", no_tests=True).collect()] == ["b.rs::helper_in_tests", "b.rs::target"]
    assert {r["id"] for r in engine.callers("target").collect()} == {"a.rs::caller", "tests/t.rs::test_it"}
    assert {r["id"] for r in engine.callers("target", no_tests=True).collect()} == {"a.rs::caller"}
    assert engine.callers("target", within="nowhere").collect() == [] and engine.callers("target", min_confidence=101).collect() == []
    assert [r["id"] for r in engine.callees("a.rs::other").collect()] == ["a.rs::caller"]
    node = engine.node(symbol="target")
    assert [r["text"] for r in node["code"].collect()] == ["fn target() { }"]
    file = engine.node(file="b.rs", offset=1, limit=1)
    assert [r["line"] for r in file["lines"].collect()] == [1, 2]
    assert {r["id"] for r in file["dependents"].collect()} == {"a.rs::caller", "tests/t.rs::test_it"}
    assert {r["id"] for r in engine.explore("target")["nodes"].collect()} == {"b.rs::target"}
    with pytest.raises(ValueError):
        engine.node()
    assert engine.describe()["search"]["arguments"]["limit"] == 30 and engine.describe()["build"]["about"]
    assert json.loads(engine.as_json(engine.callers("target", no_tests=True)))[0]["doc_comment"] is None
    assert set(json.loads(engine.as_json(engine.node(symbol="target")))) == {"nodes", "code", "callers", "callees"}
    lines = engine.as_text().split("\n")
    assert len(lines) == 7 and lines[0].startswith(".y.rs" + " " * 36 + "rust ") and len({len(x) for x in lines}) == 1
    assert "indexed at" in (tmp_path / scan.INDEX_DIR / "ABOUT.md").read_text()

    # a target moves; a missing function appears; a file goes
    put(tmp_path, {"b.rs": "fn helper_in_tests() {}\n", "c.rs": "fn target() {}\nfn missing() {}\n"})
    os.remove(tmp_path / "_x.rs")
    engine.sync()
    assert ("a.rs::caller", "c.rs::target", 0) in edges(engine) and ("a.rs::caller", "c.rs::missing", 0) in edges(engine)
    assert not any("b.rs::target" in e for e in edges(engine)) and unresolved(engine) == set()
    assert "_x.rs" not in {r["file_path"] for r in engine.files().collect()} and engine.search("magic").collect() == []
    after, left, terms = edges(engine), unresolved(engine), posted(engine)
    engine.compact()
    assert (edges(engine), unresolved(engine), posted(engine)) == (after, left, terms)
    engine.build()
    assert (edges(engine), unresolved(engine), posted(engine)) == (after, left, terms)
    engine.build(include_library=True)
    assert {"vendor/v.go", "target/z.rs"} <= {r["file_path"] for r in engine.files().collect()}


def posted(engine):
    return sorted(tuple(r) for r in engine.table("postings").collect())


def test_a_file_that_becomes_unreadable_keeps_its_rows(spark, tmp_path, caplog):
    put(tmp_path, {"a.rs": "fn a() { b(); }\n", "b.rs": "fn b() {}\n"})
    engine = Engine(spark, str(tmp_path))
    engine.build()
    before = edges(engine), posted(engine), {r["file_path"] for r in engine.files().collect()}
    (tmp_path / "b.rs").write_bytes(b"fn c\xff() {}")
    engine.sync()
    assert (edges(engine), posted(engine), {r["file_path"] for r in engine.files().collect()}) == before and "b.rs" in caplog.text
    put(tmp_path, {"b.rs": "fn c() {}\n"})
    engine.sync()
    assert edges(engine) == set() and unresolved(engine) == {("a.rs::a", "b")}


def test_each_file_is_read_and_parsed_once(spark, tmp_path, monkeypatch):
    put(tmp_path, {"a.rs": "fn a() { b(); }\n", "b.rs": "fn b() {}\n"})
    made = []
    whole = scan.scan
    monkeypatch.setattr(scan, "scan", lambda *a: made.append(whole(*a)) or made[-1])
    tables = {}
    monkeypatch.setattr("callweave.sources.store.Store.write", lambda self, t, facts: tables.update(t) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        Engine(spark, str(tmp_path)).build()
    assert len(made) == 1
    for df in tables.values():  # what is written has been read back: no Python is left in any plan
        assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pull_report_from_json_files(spark, tmp_path):
    put(tmp_path, {"w/a_test.go": "package a\nfunc TestAdd() { helper() }\nfunc helper() {}\n"})
    pull = {"number": 7, "title": "Add it", "state": "closed", "merged_at": None, "merge_commit_sha": "0123456789abcdef", "head": {"sha": None}, "labels": [{"name": "x"}, {"name": "y"}], "body": "```release-note\nNew.\n```"}
    changed = [{"filename": "a_test.go", "status": "modified", "additions": 2, "deletions": 1, "changes": 3, "patch": "+func TestAdd(t *testing.T) {\n+func TestGone(t *testing.T) {"}, {"filename": "none.md", "status": "added", "additions": 1, "deletions": 0, "changes": 1, "patch": None}]
    (tmp_path / "pull.json").write_text(json.dumps(pull, indent=1))
    (tmp_path / "files.json").write_text(json.dumps(changed, indent=1))
    engine = Engine(spark, str(tmp_path / "w"))
    engine.build()
    rows = [(r["part"], r["line"]) for r in engine.pull_report(str(tmp_path / "pull.json"), str(tmp_path / "files.json"), 1).collect()]
    assert [x for p, x in rows if p == 0] == ["PR #7: Add it", "State: closed, merged at None", "Merge commit: 0123456789ab", "Head commit: unknown", "Labels: x, y", "Release note: New.", "Shallow head: false", "Index: 1 files, 2 nodes, 1 edges"]
    assert [x for p, x in rows if p == 1] == ["a_test.go modified (+2/-1, 3 changes)", "none.md added (+1/-0, 1 changes)"]
    assert [x for p, x in rows if p == 2] == ["func TestAdd() from line 2, and 1 more", "no symbols"]
    assert [x for p, x in rows if p == 3] == ["func TestAdd() (function test) a_test.go:2", "TestGone is not in the index"]


def test_status_follows_the_tree(spark, tmp_path):
    put(tmp_path, {"a.rs": "fn a() {}\n", ".gitignore": scan.INDEX_DIR + "\n"})
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one | two")
    engine = Engine(spark, str(tmp_path))
    engine.build()
    row = engine.status().first()
    assert (row["ok"], row["freshness"], row["action"], row["nodes"]) == (True, "fresh", "none", 1)
    put(tmp_path, {"a.rs": "fn b() {}\n"})
    row = engine.status().first()
    assert (row["ok"], row["freshness"], row["action"]) == (False, "stale", "sync")


def scalar(call, callers, syms):
    """The cascade for one call, written as a loop."""
    ns, _, simple = call["callee_name"].rpartition("::")
    ns = ns.rpartition("::")[2] or None
    found = [s for s in syms if s["name"] == simple]
    owner = lambda s: s["q"].rpartition("::")[0]
    near = lambda s: owner(s).rpartition("::")[2] or None
    hint, kind, pkg = call["import_hint"], call["receiver_type"], call["package_or_namespace"]
    in_path = lambda s: hint == "" or any(all(a == b or (b == "." and a in "./\\") or (b in "/\\" and a in "/\\") for a, b in zip(s["f"][k:], hint, strict=False)) and len(s["f"]) - k >= len(hint) for k in range(len(s["f"])))
    own = callers.get(call["caller_id"])
    if hint is not None and len(hit := [s for s in found if s["q"].endswith("::" + simple) and owner(s).split("::") == hint.split(".")]) == 1:
        return {(hit[0]["id"], 5)}
    if kind is not None:
        hit = [(5 if hint is not None and in_path(s) else 4, s["id"]) for s in found if owner(s) and (owner(s) == kind or owner(s).endswith("::" + kind))]
        best = [h for h in hit if h[0] == max(hit)[0]]
        if len(best) == 1:
            return {(best[0][1], best[0][0])}
    for on, test in ((hint, in_path), (pkg, lambda s: s["q"].split("::")[0] == pkg), (ns, lambda s: s["q"].endswith(f"{ns}::{simple}"))):
        if on is not None and len(hit := [s for s in found if test(s)]) == 1:
            return {(hit[0]["id"], 3)}
    if own and near(own) and len(hit := [s for s in found if near(s) == near(own)]) == 1:
        return {(hit[0]["id"], 2)}
    if own and (hit := [s for s in found if s["f"] == own["f"]]):
        return {(s["id"], 1) for s in hit}
    return {(found[0]["id"], 0)} if len(found) == 1 else set()


def test_cascade_is_the_scalar_loop(spark):
    rng = random.Random(11)
    pick = rng.choice
    names, types, files = ["new", "get", "run", "only"], ["T", "U", "MyT"], ["src/a.rs", "src/net/b.rs", "net.c/d.rs"]
    syms = {}
    for _ in range(40):
        f, q = pick(files), "::".join([*[pick(["p", "q.r", "m"]) for _ in range(rng.randrange(2))], *[pick(types) for _ in range(rng.randrange(2))], pick(names)])
        syms[f"{f}::{q}"] = {"id": f"{f}::{q}", "name": q.split("::")[-1], "q": q, "f": f}
    syms = list(syms.values())
    nodes = spark.createDataFrame([(s["id"], s["name"], "function", s["q"], s["f"], 1, 1, 0, 0, "", None, False) for s in syms], schema.NODES)
    calls = []
    for k in range(400):
        callee = "::".join([*[pick(["p", "T", "yT", "q.r"]) for _ in range(rng.randrange(3))], pick([*names, "none"])])
        calls.append({"caller_id": pick([*syms, {"id": "gone"}])["id"], "callee_name": callee, "receiver_type": pick([None, None, "T", "q.r::U"]), "package_or_namespace": pick([None, "p", "T"]), "import_hint": pick([None, None, "", "p.T", "net", "net.b", "a.rs", "q.r.T", "net/b"]), "line": k, "column": 0})
    rows = [tuple(c.get(n) for n in schema.names(schema.RAW_CALLS)) for c in calls]
    got = {r["line"]: {(t["id"], t["kind"]) for t in r["targets"]} for r in resolve.resolve(spark.createDataFrame(rows, schema.RAW_CALLS), nodes).collect()}
    callers = {s["id"]: s for s in syms}
    for c in calls:
        assert got[c["line"]] == scalar(c, callers, syms), c


def test_query_grammar():
    for bad in ("", "Point::new", "/api", "a.b", "foo-bar", "a AND", "NOT a", "(a", "x : y", "a, b", "NEAR(a b, c)"):
        with pytest.raises(search.QuerySyntaxError):
            search.parse(bad)
    assert search.parse("a b")[0] == "and" and search.parse("a OR b AND c")[0] == "or" and search.parse("a b NOT c")[0] == "not"
    assert search.parse("helper_in_tests") == search.Phrase(("helper", "in", "tests"))
    assert search.parse("NEAR(a b, 3)")[2] == 3 and search.parse("NEAR(a b)")[2] == 10
    assert search.parse("name : ^x*") == search.Phrase(("x",), True, ("name",), True)


def test_pull_request_reports(spark):
    patch = "\n".join(["@@ -1 +1 @@", "+func TestAdd(t *testing.T) {", "-func TestGone(t *testing.T) {", "+func helper() {"])
    java = "\n".join(["+  @Test", "+  @Slow", "+  // why", "+  public void shouldWork() {", "+  void testPlain() {", "+  void other() {"])
    rows = [("a_test.go", patch), ("T.java", java), ("t.py", "+def test_x(a):\n+    def helper(): pass"), ("n.py", None)]
    tests = report.added_tests(spark.createDataFrame(rows, "filename string, patch string"))
    assert {(r["filename"], r["test"]) for r in tests.collect()} == {("a_test.go", "TestAdd"), ("T.java", "shouldWork"), ("T.java", "testPlain"), ("t.py", "test_x")}
    nodes = spark.createDataFrame([("t.py::test_x", "test_x", "function", "test_x", "t.py", 1, 1, 0, 0, "", None, True)], schema.NODES)
    assert {(r["test"]) for r in report.missing_tests(tests, nodes).where(F.col("found")).collect()} == {"test_x"}
    body = spark.createDataFrame([("x\n```release-note\nFixed it.\n```\ny",), ("none",)], "body string")
    assert [r["note"] for r in report.release_note(body).collect()] == ["Fixed it.", "unknown"]
    meta = spark.createDataFrame([("git_branch", "main"), ("indexed_at", None)], "key string, value string")
    assert [(r["title"], r["value"]) for r in report.metadata_titles(meta).collect()] == [("Git Branch", "main"), ("Indexed At", "N/A")]
