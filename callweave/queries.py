"""One query for each operator over the graph projection, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import columns as C
from callweave.operators import lookup, report, resolve, search, sync, topk, trigrams, vectors
from callweave.plans import projection as P
from callweave.plans.cut import cut, place
from callweave.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Names that the queries look for.
NAME, QNAME, FILE = "red_widget", "SMALL::Odd::Brand_4::blue_bolt", "src/small/brand_4.rs"
NODE = "id, name, kind, qualified_name, file_path, start_line, end_line, start_column, end_column, signature, doc_comment, is_test"
CONF = "CASE resolution_kind WHEN 5 THEN 100 WHEN 4 THEN 90 WHEN 3 THEN 80 WHEN 2 THEN 80 WHEN 1 THEN 60 ELSE 30 END"
LABEL = "CASE resolution_kind WHEN 5 THEN 'exact' WHEN 4 THEN 'receiver_type' WHEN 3 THEN 'package' WHEN 2 THEN 'namespace' WHEN 1 THEN 'same_file' WHEN 0 THEN 'name_only' ELSE 'unknown' END"
TOKENS = "list_filter(regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = P.sql(sql)
        return f

    return add


# -- the graph itself


@query(f"SELECT {NODE} FROM nodes")
def nodes_last_of_id(s, d):
    return P.nodes(s, d)


@query("SELECT * FROM files")
def files_table(s, d):
    return P.files(s, d)


@query('SELECT caller_id, callee_name, callee_simple, callee_scope, call_kind, receiver_expr, receiver_type, package_or_namespace, import_hint, line, "column" FROM raw_calls')
def raw_calls_table(s, d):
    return P.raw_calls(s, d)


@query('''SELECT * EXCLUDE (place) FROM (SELECT caller_id, callee_name, callee_simple, callee_scope, call_kind, receiver_expr, receiver_type, package_or_namespace, import_hint, line, "column",
            row_number() OVER (PARTITION BY caller_id, callee_name, line, "column" ORDER BY callee_simple NULLS FIRST, callee_scope NULLS FIRST, call_kind NULLS FIRST, receiver_expr NULLS FIRST, receiver_type NULLS FIRST,
                               package_or_namespace NULLS FIRST, import_hint NULLS FIRST) AS place FROM raw_calls) WHERE place = 1''')
def raw_calls_once(s, d):
    return sync.calls_once(P.raw_calls(s, d))


def resolved_in_file(s, d):
    """A single file's calls, with its symbols alone as candidates."""
    return resolve.edges_of(resolve.resolve_in_file(P.raw_calls(s, d), P.nodes(s, d), FILE))


query("SELECT * FROM edges")(resolved_in_file)
#: The same cascade over the symbols of the file and the calls that they make.
SQL["resolved_in_file"] = SQL["resolved_in_file"].replace("AS seg FROM nodes", f"AS seg FROM nodes WHERE file_path = '{FILE}'").replace("FROM raw_calls r LEFT JOIN syms", "FROM raw_calls r JOIN syms")


@query("SELECT * FROM edges")
def edges_resolved(s, d):
    return resolve.edges_of(P.resolved(s, d))


@query("SELECT * FROM unresolved_refs")
def unresolved_refs(s, d):
    return resolve.unresolved_of(P.resolved(s, d))


@query("SELECT coalesce(stage, 'unresolved') AS stage, count(DISTINCT calls.c) AS calls FROM calls LEFT JOIN hits ON hits.c = calls.c GROUP BY 1")
def resolution_stages(s, d):
    return P.resolved(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("calls"))


def _stage(stage: str) -> None:
    sql = f'SELECT calls.caller_id, callee_name, line, "column", id AS target_id, CAST(res AS INTEGER) AS kind FROM calls JOIN hits ON hits.c = calls.c WHERE stage = \'{stage}\''

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = P.resolved(s, d).where(F.col("stage") == stage).select("caller_id", "callee_name", "line", "column", F.explode("targets").alias("t"))
        return rows.select("caller_id", "callee_name", "line", "column", F.col("t.id").alias("target_id"), F.col("t.kind").alias("kind"))

    query(sql, f"resolve_{stage}")(run)


for _name in resolve.STAGES:
    _stage(_name)


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    store = P.stored_graph(s, d)
    return store.table("nodes"), store.table("edges")


# -- lookups


@query(f"SELECT {NODE} FROM nodes WHERE name = '{NAME}' AND kind = 'method'")
def find_by_name_and_kind(s, d):
    return lookup.find_nodes(P.nodes(s, d), name=NAME, kind="method")


@query(f"SELECT {NODE} FROM nodes WHERE id = '{QNAME}' OR qualified_name = '{QNAME}'")
def find_by_id_or_qualified_name(s, d):
    return lookup.find_by_id(P.nodes(s, d), QNAME)


@query(f"SELECT {NODE} FROM nodes WHERE name ILIKE '%D_wid%' OR qualified_name ILIKE '%D_wid%' OR id ILIKE '%D_wid%'")
def find_like(s, d):
    return lookup.find_like(P.nodes(s, d), "D_wid")


@query(f"""SELECT {NODE} FROM nodes WHERE CASE WHEN EXISTS (SELECT 1 FROM nodes WHERE name = '{QNAME}') THEN name = '{QNAME}' ELSE id = '{QNAME}' OR qualified_name = '{QNAME}' END""")
def symbol_ladder(s, d):
    return lookup.find_symbol(P.nodes(s, d), QNAME)


@query(f"SELECT {NODE} FROM nodes WHERE NOT is_test")
def exclude_tests(s, d):
    return lookup.without_tests(P.nodes(s, d), True)


@query(f"SELECT {NODE} FROM nodes WHERE starts_with(file_path, 'src/sm')")
def path_scope(s, d):
    return lookup.scoped(P.nodes(s, d), "src/sm")


@query(f"SELECT {NODE} FROM nodes WHERE 105 BETWEEN start_line AND end_line")
def nodes_at_line(s, d):
    return lookup.at_line(P.nodes(s, d), 105)


def _related_sql(own: str, other: str, where: str, more: str = "", extra: str = "") -> str:
    return f"""SELECT {NODE}, {LABEL} AS resolution, CAST({CONF} AS INTEGER) AS confidence
        FROM (SELECT {other} AS id, max(resolution_kind) AS resolution_kind FROM edges JOIN nodes t ON t.id = {own} WHERE {where} {extra} GROUP BY 1) JOIN nodes USING (id) {more}"""


@query(_related_sql("target_id", "source_id", f"t.name = '{NAME}'"))
def callers(s, d):
    n, e = _graph(s, d)
    return lookup.callers(lookup.find_symbol(n, NAME), e, n)


@query(_related_sql("source_id", "target_id", f"t.name = '{NAME}'"))
def callees(s, d):
    n, e = _graph(s, d)
    return lookup.callees(lookup.find_symbol(n, NAME), e, n)


@query(_related_sql("target_id", "source_id", f"t.name = '{NAME}' AND starts_with(t.file_path, 'src/') AND NOT t.is_test", "WHERE NOT is_test", f"AND {CONF} >= 80"))
def callers_filtered(s, d):
    n, e = _graph(s, d)
    targets = lookup.scoped(lookup.without_tests(lookup.find_symbol(n, NAME), True), "src/")
    return lookup.callers(targets, e, n, "calls", 80, True)


@query(_related_sql("source_id", "target_id", f"t.name = '{NAME}'", "", f"AND {CONF} >= 90"))
def callees_min_confidence(s, d):
    n, e = _graph(s, d)
    return lookup.callees(lookup.find_symbol(n, NAME), e, n, "calls", 90)


@query(_related_sql("target_id", "source_id", f"t.file_path = '{FILE}'", f"WHERE file_path <> '{FILE}'"))
def file_dependents(s, d):
    n, e = _graph(s, d)
    return lookup.dependents(FILE, e, n)


@query(f"SELECT {NODE} FROM nodes WHERE file_path = '{FILE}'")
def file_symbols(s, d):
    return lookup.file_symbols(P.nodes(s, d), FILE)


@query("SELECT file_path, language, size_bytes, files.is_test, count(n.id) AS symbols FROM files LEFT JOIN nodes n USING (file_path) GROUP BY ALL")
def files_with_counts(s, d):
    return lookup.files_with_counts(P.files(s, d), P.nodes(s, d))


@query("""SELECT source_id, target_id, e.kind, resolution_kind, a.name AS source_name, a.file_path AS source_file, b.name AS target_name, b.file_path AS target_file
          FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.file_path <> b.file_path""")
def cross_file_edges(s, d):
    n, e = _graph(s, d)
    return lookup.cross_file_edges(e, n)


@query(f"""SELECT '- ' || coalesce(qualified_name, name) || ' (' || kind || ') - ' || file_path || ':' || start_line || ' [' || {LABEL} || ', confidence ' || {CONF} || ']' AS line
           FROM (SELECT source_id AS id, max(resolution_kind) AS resolution_kind FROM edges JOIN nodes t ON t.id = target_id WHERE t.name = '{NAME}' GROUP BY 1) JOIN nodes USING (id)""")
def callers_as_text(s, d):
    return callers(s, d).select(F.concat(C.text_line(), C.resolution_suffix(F.col("resolution"), F.col("confidence"))).alias("line"))


@query(f"""SELECT file_path, count(*) AS symbols, string_agg(name, ',' ORDER BY start_line, id) AS names FROM nodes WHERE name ILIKE '%bolt%' OR qualified_name ILIKE '%bolt%' OR id ILIKE '%bolt%' GROUP BY 1""")
def grouped_by_file(s, d):
    rows = lookup.find_like(P.nodes(s, d), "bolt").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.sort_array(F.collect_list(F.struct("start_line", "id", "name"))).alias("r"))
    return rows.select("file_path", "symbols", F.array_join("r.name", ",").alias("names"))


def _contents(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))


LINES = "(SELECT 'doc/' || doc_id AS file_path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN ls[:-2] ELSE ls END AS ls FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)))"


@query(f"SELECT file_path, CAST(line AS BIGINT) AS line, regexp_replace(text, '\\r$', '') AS text FROM {LINES} WHERE line BETWEEN 2 AND 5")
def file_slice(s, d):
    return lookup.file_slice(_contents(s, d), 2, 3)


@query(f"""SELECT 'doc/' || doc_id || '::span' AS id, CAST(line AS BIGINT) AS line, regexp_replace(l.text, '\\r$', '') AS text
           FROM documents JOIN {LINES} l ON l.file_path = 'doc/' || doc_id WHERE line BETWEEN greatest(doc_id % 4, 1) AND doc_id % 4 + 2""")
def code_lines(s, d):
    spans = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), (F.col("doc_id") % 4).alias("start_line"), (F.col("doc_id") % 4 + 2).alias("end_line"))
    return lookup.code_lines(spans.withColumn("id", F.concat("file_path", F.lit("::span"))), _contents(s, d))


@query(f"""WITH RECURSIVE hop(id, hops) AS (SELECT id, 0 FROM nodes WHERE name = '{NAME}' UNION SELECT source_id, hops + 1 FROM edges JOIN hop ON target_id = id WHERE hops < 2)
           SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM hop GROUP BY id""", "k_hop_callers")
def k_hop_callers(s, d):
    n, e = _graph(s, d)
    return lookup.k_hop_callers(lookup.find_symbol(n, NAME), e, 2)


@query("SELECT id, 'added' AS change FROM nodes WHERE (start_line - 1) / 10 % 10 = 0 UNION ALL SELECT id, 'removed' FROM nodes WHERE (start_line - 1) / 10 % 10 = 7")
def snapshot_diff(s, d):
    n = P.nodes(s, d)
    key = F.floor((F.col("start_line") - 1) / 10) % 10
    return lookup.snapshot_diff(n.where(key != 0), n.where(key != 7))


# -- reports


@query("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def totals(s, d):
    n, e = _graph(s, d)
    return report.totals(P.files(s, d), n, e)


@query("SELECT coalesce(language, 'unknown') AS language, count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM files GROUP BY 1")
def files_by_language(s, d):
    return report.by_language(P.files(s, d))


@query("SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM files")
def language_totals(s, d):
    return report.language_totals(P.files(s, d))


@query("""SELECT file_path, CASE WHEN length(file_path) > 50 THEN '...' || right(file_path, 47) ELSE file_path END AS shown, coalesce(language, 'unknown') AS language, count(id) AS symbols
          FROM files LEFT JOIN nodes USING (file_path) GROUP BY file_path, language ORDER BY symbols DESC, file_path LIMIT 5""")
def largest_files(s, d):
    return report.largest_files(P.files(s, d), P.nodes(s, d))


@query("""SELECT file_path, CASE WHEN length(file_path) < 40 THEN rpad(file_path, 40, ' ') ELSE file_path END || ' ' || rpad(coalesce(language, 'unknown'), 10, ' ') || ' ' || rpad(size_bytes::VARCHAR, 10, ' ')
          || ' ' || rpad(is_test::VARCHAR, 8, ' ') || ' ' || rpad(count(id)::VARCHAR, 12, ' ') AS line FROM (SELECT file_path, language, size_bytes, files.is_test FROM files) LEFT JOIN nodes USING (file_path) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY file_path, language, size_bytes, f.is_test").replace("FROM files) LEFT", "FROM files) f LEFT").replace("rpad(is_test::", "rpad(f.is_test::"))
def files_as_text(s, d):
    return report.files_as_text(lookup.files_with_counts(P.files(s, d), P.nodes(s, d)))


@query("SELECT name, kind, qualified_name, file_path, start_line, end_line, signature, is_test FROM nodes WHERE name IN (SELECT DISTINCT name FROM nodes WHERE is_test)")
def symbols_named(s, d):
    nodes = P.nodes(s, d)
    return report.symbols_named(nodes, nodes.where("is_test").select("name"))


#: Bodies of pull requests made of the nations' names, and what is said in their blocks for release notes.
BODY = {0: "'none: ' || n_name", 1: "'x' || chr(10) || '```release-note' || chr(10) || n_name || '  is' || chr(10) || chr(9) || 'new. ' || chr(10) || '```' || chr(10) || 'y'", 2: "'```release-note' || chr(10) || '```'", 3: "NULL"}


@query(f"""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN n_name || ' is new.' WHEN 2 THEN 'empty' ELSE 'unknown' END AS note FROM nation""")
def release_notes(s, d):
    body = F.expr("CASE n_nationkey % 4 " + " ".join(f"WHEN {k} THEN {x}" for k, x in BODY.items()) + " END")
    rows = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", body.alias("body"))
    return rows.join(report.release_note(rows.select("body").distinct()), "body", "left").select("n_nationkey", F.coalesce("note", F.lit("unknown")).alias("note"))


#: Added lines of patches by the remainder of a supplier's key, and the test that each declares.
PATCHES = [
    ("a_test.go", "+func Test%d(t *testing.T) {\n-func TestGone(t *testing.T) {\n+func helper() {", "Test%d"),
    ("t.py", "+    async def test_%d(self):\n+    def helper(): pass", "test_%d"),
    ("T.java", "+  @Test\n+  @Slow(1)\n+\n+  // why\n+  public void works%d() { foo(); }", "works%d"),
    ("U.java", "+  @Test\n   int context;\n+  public void not%d() {\n+  private void testPlain%d() {", "testPlain%d"),
    ("n.rs", "+fn test_%d() {}", None),
]


@query("SELECT * FROM (SELECT DISTINCT CASE s_suppkey % 5 " + " ".join(f"WHEN {k} THEN s_suppkey || '{name}'" for k, (name, _, _) in enumerate(PATCHES)) + " END AS filename, CASE s_suppkey % 5 "
       + " ".join(f"WHEN {k} THEN replace('{test}', '%d', s_suppkey::VARCHAR)" for k, (_, _, test) in enumerate(PATCHES) if test) + " END AS test FROM supplier) WHERE test IS NOT NULL")
def added_tests(s, d):
    k = F.col("s_suppkey").cast("string")
    of = lambda part: F.get(F.array(*[F.lit(p[part]) for p in PATCHES]), (F.col("s_suppkey") % 5).cast("int"))
    rows = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(k, of(0)).alias("filename"), F.replace(of(1), F.lit("%d"), k).alias("patch"))
    return report.added_tests(rows)


#: The index's facts and the tree's, in any combination.
FACTS = "(SELECT * FROM (VALUES (CAST(NULL AS INTEGER)), (6), (5)) a(found_schema), (VALUES (CAST(NULL AS VARCHAR)), ('x'), ('N/A')) b(indexed_sha), (VALUES (CAST(NULL AS VARCHAR)), ('x'), ('y')) c(head_sha), (VALUES ('clean'), ('dirty')) e(indexed_status), (VALUES (CAST(NULL AS VARCHAR)), ('clean'), ('dirty')) f(live_status))"


@query(f"""SELECT *, CASE WHEN NOT schema_match OR nodes = 0 THEN 'init' WHEN freshness = 'stale' THEN 'sync' ELSE 'none' END AS action, schema_match AND nodes > 0 AND freshness <> 'stale' AS ok
           FROM (SELECT *, coalesce(found_schema = 6, false) AS schema_match, CASE WHEN head_sha IS NULL OR live_status IS NULL OR indexed_sha IS NULL OR indexed_sha IN ('', 'N/A') THEN 'unknown'
                 WHEN indexed_sha = head_sha AND indexed_status = 'clean' AND live_status = 'clean' THEN 'fresh' ELSE 'stale' END AS freshness
                 FROM {FACTS}, (SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges))""")
def status_verdicts(s, d):
    n, e = _graph(s, d)
    return report.status(report.totals(P.files(s, d), n, e), s.sql(f"SELECT * FROM {FACTS}".replace("VARCHAR", "STRING")), 6)


@query("SELECT kind, count(*) AS symbols FROM nodes GROUP BY 1")
def nodes_by_kind(s, d):
    return report.by_kind(P.nodes(s, d))


@query("""SELECT n.id, n.name, n.kind, CASE WHEN length(file_path) > 55 THEN '...' || right(file_path, 52) ELSE file_path END AS shown, calls
          FROM (SELECT target_id AS id, count(*) AS calls FROM edges WHERE kind = 'calls' GROUP BY 1 ORDER BY calls DESC, id LIMIT 5) JOIN nodes n USING (id)""")
def hotspots(s, d):
    n, e = _graph(s, d)
    return report.hotspots(e, n)


@query(f"SELECT name, count(*) AS edges, count(DISTINCT target_id) AS targets FROM edges JOIN nodes ON id = target_id WHERE name IN ('{NAME}', 'blue_bolt', 'none') GROUP BY 1")
def name_noise(s, d):
    n, e = _graph(s, d)
    return report.name_noise(e, n, [NAME, "blue_bolt", "none"])


@query("SELECT a.name AS source_name, b.name AS target_name, resolution_kind FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE ends_with(lower(a.file_path), 'brand_4.rs')")
def callers_in_file(s, d):
    n, e = _graph(s, d)
    return report.callers_in(e, n, "Brand_4.rs")


@query("""SELECT file_path AS filename, 'modified' AS status, CAST(rank AS INTEGER) AS rank, name, kind, start_line, greatest(total - 12, 0) AS more
          FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, name, id) AS rank, count(*) OVER (PARTITION BY file_path) AS total FROM nodes WHERE file_path LIKE 'src/small/%') WHERE rank <= 12""")
def changed_file_symbols(s, d):
    changed = P.files(s, d).where(F.startswith("file_path", F.lit("src/small/"))).select(F.col("file_path").alias("filename"), F.lit("modified").alias("status"))
    return report.changed_symbols(changed, P.nodes(s, d))


@query("""SELECT custkey % 7 AS case_id, CASE WHEN head IS NULL OR live IS NULL OR sha IS NULL OR sha IN ('', 'N/A') THEN 'unknown' WHEN sha = head AND was = 'clean' AND live = 'clean' THEN 'fresh' ELSE 'stale' END AS freshness
          FROM (SELECT c_custkey AS custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' ELSE 'a' END AS sha, CASE c_custkey % 7 WHEN 2 THEN NULL WHEN 3 THEN 'b' ELSE 'a' END AS head,
                       CASE c_custkey % 7 WHEN 4 THEN 'dirty' ELSE 'clean' END AS was, CASE c_custkey % 7 WHEN 5 THEN 'dirty' ELSE 'clean' END AS live FROM customer) GROUP BY ALL""")
def index_freshness(s, d):
    k = F.col("c_custkey") % 7
    rows = s.read.parquet(f"{d}/customer.parquet").select(k.alias("case_id")).distinct()
    k = F.col("case_id")
    sha = F.when(k == 1, "N/A").when(k != 0, "a")
    head = F.when(k == 3, "b").when(k != 2, "a")
    return rows.select("case_id", C.freshness(sha, head, F.when(k == 4, "dirty").otherwise("clean"), F.when(k == 5, "dirty").otherwise("clean")).alias("freshness"))


# -- scalar functions


PATHS = """(SELECT CASE l_orderkey % 9 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'src/test/java/' WHEN 3 THEN 'vendor/x/' WHEN 4 THEN '.git/' WHEN 5 THEN '.venv/lib/' WHEN 6 THEN 'a/target/b/' WHEN 7 THEN 'my_tests/' ELSE '' END
    || 'f' || l_linenumber || CASE l_partkey % 10 WHEN 0 THEN '.rs' WHEN 1 THEN '_test.go' WHEN 2 THEN '.JAVA' WHEN 3 THEN '.h' WHEN 4 THEN '.hpp' WHEN 5 THEN '.zig' WHEN 6 THEN '.py' WHEN 7 THEN '' WHEN 8 THEN '.cc' ELSE '.go' END AS path FROM lineitem)"""


def _paths(s: SparkSession, d: str) -> DataFrame:
    item = s.read.parquet(f"{d}/lineitem.parquet")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    folder = pick(["src/", "tests/", "src/test/java/", "vendor/x/", ".git/", ".venv/lib/", "a/target/b/", "my_tests/", ""], F.col("l_orderkey") % 9)
    ext = pick([".rs", "_test.go", ".JAVA", ".h", ".hpp", ".zig", ".py", "", ".cc", ".go"], F.col("l_partkey") % 10)
    return item.select(F.concat(folder, F.lit("f"), F.col("l_linenumber").cast("string"), ext).alias("path"))


@query(f"""SELECT path, CASE regexp_extract(lower(path), '[^/]\\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c'
           WHEN 'cc' THEN 'cpp' WHEN 'cpp' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hh' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'hxx' THEN 'cpp' WHEN 'zig' THEN 'zig' END AS language, count(*) AS n FROM {PATHS} GROUP BY ALL""")
def language_of_path(s, d):
    return _paths(s, d).groupBy("path", C.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT path, ends_with(path, '_test.go') OR list_contains(string_split(path, '/'), 'tests') OR contains('/' || path || '/', '/src/test/') AS is_test, count(*) AS n FROM {PATHS} GROUP BY ALL")
def test_paths(s, d):
    return _paths(s, d).groupBy("path", C.is_test_path(F.col("path")).alias("is_test")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT path, len(list_filter(string_split(path, '/')[:-2], lambda x: x IN ('.git', 'target', 'node_modules', '.venv', 'vendor', 'build', 'dist') OR starts_with(x, '.'))) > 0 AS skipped,
           len(list_filter(string_split(path, '/')[:-2], lambda x: x = '.git' OR (starts_with(x, '.') AND x <> '.venv'))) > 0 AS skipped_with_library, count(*) AS n FROM {PATHS} GROUP BY ALL""")
def skipped_paths(s, d):
    return _paths(s, d).groupBy("path", C.is_skipped(F.col("path")).alias("skipped"), C.is_skipped(F.col("path"), True).alias("skipped_with_library")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT callee_name, string_split(callee_name, '::')[-1] AS simple, CASE WHEN contains(callee_name, '::') THEN string_split(callee_name, '::')[-2] END AS namespace,
          CASE WHEN contains(callee_name, '::') THEN array_to_string(string_split(callee_name, '::')[:-2], '::') END AS scope
          FROM (SELECT callee_name FROM raw_calls UNION ALL SELECT qualified_name FROM nodes)""")
def split_names(s, d):
    rows = P.raw_calls(s, d).select("callee_name").unionAll(P.nodes(s, d).select("qualified_name")).distinct()
    c = F.col("callee_name")
    return rows.select(c, C.simple_name(c).alias("simple"), C.callee_namespace(c).alias("namespace"), C.callee_scope(c).alias("scope"))


@query(f"SELECT resolution_kind, {LABEL} AS label, CAST({CONF} AS INTEGER) AS confidence, count(*) AS n FROM edges GROUP BY ALL")
def resolution_confidence(s, d):
    k = F.col("resolution_kind")
    return _graph(s, d)[1].groupBy(k, C.resolution_label(k).alias("label"), C.confidence(k).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a, b, '/' || CASE WHEN trim(a, '/') <> '' AND trim(b, '/') <> '' THEN trim(a, '/') || '/' || trim(b, '/') ELSE trim(a, '/') || trim(b, '/') END AS path
          FROM (SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/api/' ELSE 'api' END AS a, CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN 'x/{id}' WHEN 3 THEN '/x' ELSE '/x/' END AS b FROM nation)""")
def combined_paths(s, d):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    k = F.col("n_nationkey")
    rows = s.read.parquet(f"{d}/nation.parquet").select(pick(["", "/", "/api/", "api"], k % 4).alias("a"), pick(["", "/", "x/{id}", "/x", "/x/"], k % 5).alias("b")).distinct()
    return rows.select("a", "b", C.combine_paths(F.col("a"), F.col("b")).alias("path"))


@query("""WITH hints AS MATERIALIZED (SELECT unnest(list_distinct(list(import_hint))) AS hint FROM raw_calls UNION ALL SELECT ''),
       paths AS MATERIALIZED (SELECT file_path || '' AS path FROM files),
       pairs AS MATERIALIZED (SELECT hint, path, strpos(translate(path, '/\\', '..'), translate(hint, '/\\', '..')) AS place FROM hints, paths)
       SELECT hint, path, true AS hit FROM pairs WHERE place > 0 AND (NOT contains(hint, '/') OR contains(path, hint) OR hint = '')""")
def import_hints(s, d):
    hints = P.raw_calls(s, d).where("import_hint is not null").select(F.col("import_hint").alias("hint"))
    hints = hints.unionAll(s.range(1).select(F.lit("").alias("hint"))).distinct()
    return hints_in_paths(hints, P.files(s, d).select(F.col("file_path").alias("path")))


def hints_in_paths(hints: DataFrame, paths: DataFrame, letters: int = 8) -> DataFrame:
    """hint, path, hit of every match; they meet where the path has the hint's first letters, separators being alike."""
    alike = lambda c: F.translate(c, ".\\", "//")
    starts = F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), F.lit(letters)), lambda n: F.substring(alike(F.col("path")), i, n))))
    keyed = paths.select("path", F.explode(F.array_distinct(parts)).alias("key"))
    pairs = hints.select("hint", F.left(alike(F.col("hint")), F.lit(letters)).alias("key")).join(keyed, "key")
    return pairs.select("hint", "path", C.path_matches_hint(F.col("path"), F.col("hint")).alias("hit")).where("hit")


# -- search


POST = "(" + " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest({TOKENS.format(c)}) AS term, generate_subscripts({TOKENS.format(c)}, 1) - 1 AS pos FROM nodes" for c in search.COLUMNS) + ")"


def _bm25_sql(*groups: str, having: str) -> str:
    """BM25 of single words, each a condition on the term."""
    parts = " UNION ALL ".join(
        f"""SELECT id, -greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tokens / mean))) AS r
            FROM (SELECT id, count(*) AS tf FROM post WHERE {g} GROUP BY 1), (SELECT count(DISTINCT id) AS df FROM post WHERE {g}), lengths USING (id), stats""".replace(", lengths USING (id), stats", ")").replace(
            "FROM (SELECT id, count(*) AS tf", "FROM ((SELECT id, count(*) AS tf"
        ).replace("GROUP BY 1), (SELECT count", "GROUP BY 1) t CROSS JOIN (SELECT count").replace(f"WHERE {g}))", f"WHERE {g}) f JOIN lengths USING (id) CROSS JOIN stats)")
        for g in groups
    )
    return f"""SELECT id, round(sum(r), 9) AS rank FROM (WITH post AS {POST}, lengths AS (SELECT nodes.id, count(term) AS tokens FROM nodes LEFT JOIN post USING (id) GROUP BY 1),
        stats AS (SELECT count(*) AS docs, avg(tokens) AS mean FROM lengths) SELECT * FROM ({parts}) WHERE id IN (SELECT id FROM post GROUP BY id HAVING {having})) GROUP BY id"""


@query(f"SELECT id, col, term, CAST(pos AS INTEGER) AS pos FROM {POST}")
def search_postings(s, d):
    return search.postings(P.nodes(s, d))


def _match(s: SparkSession, d: str, text: str) -> DataFrame:
    store = P.stored_texts(s, d)
    return search.match(store.table("nodes"), text, store.table("postings"))


def _ranked(text: str) -> Query:
    return lambda s, d: _match(s, d, text).select("id", F.round("rank", 9).alias("rank"))


query(_bm25_sql("term = 'red'", "term = 'widget'", having="bool_or(term = 'red') AND bool_or(term = 'widget')"), "search_two_words")(_ranked("red widget"))
query(_bm25_sql("starts_with(term, 'wid')", "term = 'promo'", having="bool_or(starts_with(term, 'wid')) OR bool_or(term = 'promo')"), "search_prefix_or")(_ranked("wid* OR promo"))
query(_bm25_sql("term = 'bolt'", "term = 'blue'", having="bool_or(term = 'bolt') AND NOT bool_or(term = 'blue')"), "search_not")(_ranked("bolt NOT blue"))
query(_bm25_sql("col = 'doc_comment' AND term = 'small'", having="bool_or(col = 'doc_comment' AND term = 'small')"), "search_column")(_ranked("doc_comment : small"))


def _best(text: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        store, docs = P.stored_impacts(s, d), P.stored_texts(s, d).counts()["nodes"]
        return topk.Best(s, store.table("impacts"), store.table("impact_blocks"), docs)(text)

    return run


def _best_sql(*words: str, having: str) -> str:
    return f"SELECT id, rank FROM ({_bm25_sql(*[f'term = {w!r}' for w in words], having=having)}) ORDER BY rank, id LIMIT 30"


query(_best_sql("bolt", having="bool_or(term = 'bolt')"), "search_best_of_one_word")(_best("bolt"))
query(_best_sql("red", "widget", having="bool_or(term = 'red') AND bool_or(term = 'widget')"), "search_best_of_all_words")(_best("red widget"))
query(_best_sql("red", "promo", "anvil", having="bool_or(term IN ('red', 'promo', 'anvil'))"), "search_best_of_any_word")(_best("red OR promo OR anvil"))


@query(f"WITH post AS {POST} SELECT DISTINCT a.id FROM post a JOIN post b ON a.id = b.id AND a.col = b.col AND abs(b.pos - a.pos) <= 2 WHERE a.term = 'bolt' AND b.term = 'brand'")
def search_near_by(s, d):
    return _match(s, d, "NEAR(bolt brand, 1)").select("id")


@query(f"WITH post AS {POST} SELECT DISTINCT a.id FROM post a JOIN post b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'blue' AND b.term = 'bolt'")
def search_phrase(s, d):
    return _match(s, d, '"blue bolt"').select("id")


@query(f"WITH post AS {POST} SELECT DISTINCT a.id FROM post a JOIN post b ON a.id = b.id AND a.col = b.col AND abs(b.pos - a.pos) <= 11 WHERE a.term = 'bolt' AND b.term = 'brand'")
def search_near(s, d):
    return _match(s, d, "NEAR(bolt brand)").select("id")


def _like(pattern: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        store = P.stored_texts(s, d)
        return trigrams.find_like_indexed(store.table("nodes"), store.table("trigrams"), pattern)

    query(f"SELECT {NODE} FROM nodes WHERE " + " OR ".join(f"{c} ILIKE '%{pattern}%'" for c in trigrams.TEXTS), sql)(run)


_like("Ue_Bolt", "like_by_trigrams")
_like("odd::brand_1%red", "like_by_trigrams_wildcards")
_like("_4", "like_of_short_runs")


@query(f"""SELECT {NODE} FROM nodes WHERE name ILIKE '%SMALL::Odd%' OR qualified_name ILIKE '%SMALL::Odd%' OR id ILIKE '%SMALL::Odd%'
           ORDER BY CASE WHEN lower(name) = 'small::odd' THEN 0 WHEN starts_with(lower(name), 'small::odd') THEN 1 WHEN contains(lower(name), 'small::odd') THEN 2 ELSE 3 END, strlen(name), name, id LIMIT 30""")
def search_falls_back_to_like(s, d):
    return search.search(P.nodes(s, d), "SMALL::Odd").drop("rank")


@query(f"""WITH post AS {POST}, hit AS (SELECT id FROM post GROUP BY id HAVING bool_or(term = 'red') AND bool_or(term = 'widget'))
           SELECT name, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM hit) AND NOT is_test GROUP BY 1
           QUALIFY row_number() OVER (ORDER BY CASE WHEN name = 'red widget' THEN 0 WHEN starts_with(name, 'red widget') THEN 1 WHEN contains(name, 'red widget') THEN 2 ELSE 3 END, strlen(name), name) <= 1""")
def search_top_name(s, d):
    rows = lookup.without_tests(search.ladder(P.nodes(s, d), "red widget"), True)
    first = search.search(P.nodes(s, d), "red widget", 1, True).select("name")
    return rows.join(first, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT greatest(count(*) - 30, 0) AS more FROM (SELECT id FROM {POST} GROUP BY id HAVING bool_or(term = 'widget'))")
def search_more(s, d):
    return search.more_than(P.nodes(s, d), "widget")


# -- vectors


@query("""WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
          SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank, id, similarity
                         FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS similarity FROM r a JOIN r b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0))
          WHERE rank <= 10""")
def vector_top_k(s, d):
    rows = vectors.usable(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")
    return vectors.top_k(rows.where(F.col("id") % 50 == 0), rows, 10)


# -- incremental maintenance


def _old_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The files before: those with the symbols of every tenth part had another hash."""
    touched = nodes.where((F.col("start_line") - 1) % 100 == 0).select("file_path").distinct().withColumn("touched", F.lit(True))
    return files.join(touched, "file_path", "left").withColumn("content_hash", F.when(F.col("touched"), "old").otherwise(F.col("content_hash"))).drop("touched")


def _snapshots(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Before: without the symbols of every tenth part and the calls from them. After: all."""
    nodes, calls, files = cut(P.nodes(s, d)), cut(P.raw_calls(s, d)), cut(P.files(s, d))
    old = nodes.where((F.col("start_line") - 1) % 100 != 0)
    kept = calls.join(old.select(F.col("id").alias("caller_id")), "caller_id", "left_semi")
    old_files = _old_files(nodes, files)
    found = cut(resolve.resolve(kept, old).select(*resolve.FOUND))
    before = {"nodes": old, "files": old_files, "raw_calls": kept, "edges": resolve.edges_of(found), "unresolved_refs": resolve.unresolved_of(found)}
    return before, {"nodes": nodes, "files": files, "raw_calls": calls}


@query("SELECT * FROM edges")
def incremental_edges(s, d):
    before, after = _snapshots(s, d)
    return sync.apply_changes(before, after)["edges"]


@query("SELECT DISTINCT * FROM unresolved_refs")
def incremental_unresolved(s, d):
    before, after = _snapshots(s, d)
    return sync.apply_changes(before, after)["unresolved_refs"].distinct()


@query("SELECT DISTINCT file_path FROM nodes WHERE (start_line - 1) % 100 = 0")
def modified_files(s, d):
    files = cut(P.files(s, d))
    return sync.modified(_old_files(P.nodes(s, d), files), files).select("file_path")


@query(f"SELECT id, col, term, CAST(pos AS INTEGER) AS pos FROM {POST}")
def stored_postings_after_changes(s, d):
    """An index of the symbols before, and a change of every tenth part's: taken away by id, and brought."""
    nodes = cut(P.nodes(s, d))
    touched = (F.col("start_line") - 1) % 100 == 0
    old = nodes.where(~touched).unionByName(nodes.where((F.col("start_line") - 1) % 300 == 0).withColumn("doc_comment", F.lit("words that go")))
    store = Store(s, place(s, "changed"))
    store.write({"nodes": old, "postings": search.index_rows(old)}, {})
    ids = nodes.where(touched).select("id")
    store.append({"nodes": (nodes.where(touched).select("file_path").distinct(), nodes.join(nodes.where(touched).select("file_path").distinct(), "file_path", "left_semi")), "postings": (ids, search.index_rows(nodes.where(touched)))}, {})
    return store.table("postings").join(store.table("nodes").select("id"), "id", "left_semi").select("id", "col", "term", "pos")


@query("SELECT file_path FROM files WHERE is_test")
def pruned_files(s, d):
    files = P.files(s, d)
    return sync.pruned(files, files.where("not is_test")).select("file_path")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of the most called symbols, with how sure each call is."""
    n, e = _graph(spark, sf_dir)
    most = report.hotspots(e, n).select("id")
    return lookup.callers(most, e, n)
