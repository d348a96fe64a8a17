"""How resolution and the questions of the graph move calls and edges, and names that one symbol has."""

import random

from callweave import queries, schema
from callweave.operators import lookup, resolve, sync
from callweave.plans import projection
from tests.test_engine import scalar

SF = "/root/testdata/sf0.001"


def test_names_of_one_symbol_pass_the_same_stages(spark):
    rng = random.Random(5)
    pick = rng.choice
    names, types, files = [f"n{k}" for k in range(30)], ["T", "U", "MyT"], ["src/a.rs", "src/net/b.rs", "net.c/d.rs"]
    syms = {}
    for _ in range(45):
        f, q = pick(files), "::".join([*[pick(["p", "q.r", "m"]) for _ in range(rng.randrange(3))], *[pick(types) for _ in range(rng.randrange(2))], pick(names)])
        syms[f"{f}::{q}"] = {"id": f"{f}::{q}", "name": q.split("::")[-1], "q": q, "f": f}
    syms = list(syms.values())
    nodes = spark.createDataFrame([(s["id"], s["name"], "function", s["q"], s["f"], 1, 1, 0, 0, "", None, False) for s in syms], schema.NODES)
    calls = []
    for k in range(1500):
        callee = "::".join([*[pick(["p", "T", "yT", "q.r", ""]) for _ in range(rng.randrange(3))], pick([*names, "none"])])
        calls.append({"caller_id": pick([*syms, {"id": "gone"}])["id"], "callee_name": callee, "receiver_type": pick([None, None, "T", "p::U", "U"]), "package_or_namespace": pick([None, "p", "T"]), "import_hint": pick([None, None, "", "p.T", "m.U", "net", "net.b", "a.rs", "src.net.b", "net/b"]), "line": k, "column": 0})
    rows = [tuple(c.get(n) for n in schema.names(schema.RAW_CALLS)) for c in calls]
    found = resolve.resolve(spark.createDataFrame(rows, schema.RAW_CALLS), nodes).collect()
    got = {r["line"]: {(t["id"], t["kind"]) for t in r["targets"]} for r in found}
    assert len(found) == len(calls) and {r["stage"] for r in found} == {*resolve.STAGES, "unresolved"}
    callers = {s["id"]: s for s in syms}
    for c in calls:
        if not c["callee_name"].startswith("::") and "::::" not in c["callee_name"]:  # the loop takes an empty namespace for none
            assert got[c["line"]] == scalar(c, callers, syms), c


def test_calls_meet_few_tables(spark):
    """Each of them moves the calls, where it is large; a lookup for each stage made nine."""
    found = resolve.resolve(projection.raw_calls(spark, SF), projection.nodes(spark, SF))
    own = projection.raw_calls(spark, SF)
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join ")
    assert joins(found) - joins(own) <= 5


def test_rims_stand_for_the_edges(spark, tmp_path):
    edges = [(f"{k}", f"{k // 2}", "calls", 5) for k in range(1, 40)]
    spark.createDataFrame(edges, schema.EDGES).write.parquet(f"{tmp_path}/edges")
    stored = spark.read.parquet(f"{tmp_path}/edges")
    found = lookup.k_hop_callers(spark.createDataFrame([("3",), ("3",)], "id string"), stored, 2)
    assert {tuple(r) for r in found.collect()} == {("3", 0), ("6", 1), ("7", 1), ("12", 2), ("13", 2), ("14", 2), ("15", 2)}
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]


def test_modified_files_ask_no_calls(spark, monkeypatch):
    monkeypatch.setattr(projection, "raw_calls", lambda *_: 1 / 0)
    got = {r[0] for r in queries.queries()["modified_files"](spark, SF).collect()}
    nodes = projection.nodes(spark, SF).where("(start_line - 1) % 100 = 0").select("file_path")
    assert got == {r[0] for r in nodes.collect()} and got


def test_stored_results_hold_what_is_read(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sync, "cut", lambda df: kept.append(df.columns) or df)
    before = projection.graph(spark, SF)
    sync.changes(before, before)
    assert [c for c in kept if "targets" in c] == [resolve.FOUND]
