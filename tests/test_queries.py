"""A few of the queries against their SQL at the smallest scale; tools/compare.py runs them all."""

from pathlib import Path

import duckdb
import pytest

from callweave import queries

SF = "/root/testdata/sf0.001"
NAMES = [
    "nodes_last_of_id", "files_table", "edges_resolved", "unresolved_refs", "callers", "callees_min_confidence", "files_with_counts", "hotspots",
    "search_two_words", "search_not", "search_phrase", "file_slice", "test_paths", "skipped_paths", "combined_paths", "changed_file_symbols",
    "raw_calls_once", "resolved_in_file", "like_by_trigrams", "like_of_short_runs", "stored_postings_after_changes", "search_best_of_any_word", "vector_top_k", "incremental_edges",
]


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        out.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, db, name):
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(queries.oracle_sql()[name])
    assert cols == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.select(*cols).collect()), key=repr)
    assert rows == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_import_hints_are_brute_force(spark):
    """Every distinct hint of the table against every path."""
    got = sorted((r["hint"], r["path"]) for r in queries.import_hints(spark, SF).collect())
    hints = {r[0] for r in queries.P.raw_calls(spark, SF).select("import_hint").distinct().collect() if r[0] is not None} | {""}
    paths = [r[0] for r in queries.P.files(spark, SF).select("file_path").collect()]
    same = lambda a, b: a == b or (b == "." and a in "./\\") or (b in "/\\" and a in "/\\")
    within = lambda h, p: any(all(map(same, p[k:], h)) for k in range(len(p) - len(h) + 1))
    assert got == sorted((h, p) for h in hints for p in paths if within(h, p))
    assert len({h for h, _ in got if h.startswith("src/")}) > 10
    odd = ["", ".", "a.b", "a/b", "b\\c", "x.long.name.of.a.module", "long/name", "(a", "é.b"]
    files = ["", "a/b", "a.b", "a\\b\\c", "x/long/name/of/a/module.rs", "x/long/name/of/b.rs", "(a)", "é/b", "ab"]
    rows = queries.hints_in_paths(spark.createDataFrame([(x,) for x in odd], "hint string"), spark.createDataFrame([(x,) for x in files], "path string"))
    assert sorted((r["hint"], r["path"]) for r in rows.collect()) == sorted((h, p) for h in odd for p in files if within(h, p))


def test_top_name_is_counted_whole(spark, monkeypatch):
    """However few rows a search gives."""
    whole = queries.search.search
    monkeypatch.setattr(queries.search, "search", lambda nodes, text, limit=30, no_tests=False: whole(nodes, text, min(limit, 2), no_tests))
    nodes = queries.P.nodes(spark, SF)
    copies = nodes.withColumn("name", queries.F.lit("red widget")).withColumn("is_test", queries.F.lit(False))
    monkeypatch.setattr(queries.P, "nodes", lambda s, d: copies)
    (row,) = queries.search_top_name(spark, SF).collect()
    assert (row["name"], row["n"]) == ("red widget", copies.count()) and row["n"] > 2


def test_flagship_has_rows(spark):
    assert queries.flagship(spark, SF).count() > 0
