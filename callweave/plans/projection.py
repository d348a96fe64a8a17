"""A code graph made of the star-schema tables: parts are symbols, line items are call sites.

The same projection in DuckDB's SQL is PROJECTION_SQL, so that every operator has an exact counterpart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave import schema
from callweave.functions.columns import is_test_path
from callweave.operators import search, topk, trigrams
from callweave.operators.resolve import edges_of, resolve, unresolved_of
from callweave.plans.cut import cut, place
from callweave.sources.store import Store


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each part; several parts may have the same id."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    unique = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("_"), F.col("p_partkey").cast("string"))).otherwise("")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), unique)
    p = p.select("p_partkey", "p_name", "p_type", "p_size", brand.alias("brand"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, "Even").otherwise("Odd").alias("grp"))
    qname = F.concat_ws("::", "p_type", "grp", "brand", "name")
    folder = F.when(F.col("p_type") == "PROMO", "tests/").otherwise("src/")
    path = F.concat(folder, F.lower("p_type"), F.lit("/"), F.lower("brand"), F.lit(".rs"))
    p = p.withColumns({"qualified_name": qname, "file_path": path})
    kind = F.element_at(F.array(*map(F.lit, ("function", "method", "struct", "class"))), F.col("p_size") % 4 + 1)
    start = F.col("p_partkey") * 10 + 1
    doc = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("/// "), F.col("p_name"), F.lit(" for "), F.lower("p_type")))
    return p.select(
        "p_partkey", "p_type", "grp", "brand",
        F.concat_ws("::", "file_path", "qualified_name").alias("id"), "name", kind.alias("kind"), "qualified_name", "file_path",
        start.alias("start_line"), (start + F.col("p_size")).alias("end_line"), F.lit(0).cast("long").alias("start_column"), (F.col("p_size") % 40).cast("long").alias("end_column"),
        F.concat(F.lit("fn "), "name", F.lit("("), F.lower("p_type"), F.lit(": "), "brand", F.lit(")")).alias("signature"), doc.alias("doc_comment"), is_test_path(F.col("file_path")).alias("is_test"),
    )


def last_of_id(rows: DataFrame, seq: str) -> DataFrame:
    """Of rows with the same id the last one written."""
    latest = Window.partitionBy("id").orderBy(F.desc(seq))
    return rows.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of_id(part_symbols(spark, sf_dir), "p_partkey").select(*schema.names(schema.NODES))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir).groupBy("file_path").agg(F.sum(F.octet_length("signature")).alias("size_bytes"), F.min("start_line").alias("last_modified"), F.max("is_test").alias("is_test"))
    n = F.length("file_path") % 4
    language = F.when(n == 0, "rust").when(n == 1, "go").when(n == 2, "java")
    return rows.select("file_path", F.md5(F.col("file_path")).alias("content_hash"), language.alias("language"), "size_bytes", "last_modified", "is_test")


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part_symbols(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    a = parts.select(F.col("p_partkey").alias("l_partkey"), F.col("id").alias("caller_id"), F.col("start_line").alias("caller_line"))
    b = parts.select(F.col("p_partkey").alias("callee_key"), *[F.col(c).alias(f"b_{c}") for c in ("p_type", "grp", "brand", "name", "file_path")])
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("callee_key"))
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    j = item.join(a, "l_partkey").join(b, "callee_key")
    callee = F.when(k == 4, F.concat_ws("::", "b_brand", "b_name")).when(k == 7, F.concat(F.lit("missing_"), "b_name")).otherwise(F.col("b_name"))
    hint = F.when(k == 0, F.concat_ws(".", "b_p_type", "b_grp", "b_brand")).when(k.isin(2, 5), F.col("b_file_path"))
    none = F.lit(None).cast("string")
    return j.select(
        "caller_id", callee.alias("callee_name"), F.when(k == 7, F.concat(F.lit("missing_"), "b_name")).otherwise(F.col("b_name")).alias("callee_simple"),
        F.when(k == 4, F.col("b_brand")).alias("callee_scope"), F.when(k == 1, "method").when(k == 3, "function").alias("call_kind"), none.alias("receiver_expr"),
        F.when(k.isin(1, 2), F.col("b_brand")).alias("receiver_type"), F.when(k == 3, F.col("b_p_type")).alias("package_or_namespace"), hint.alias("import_hint"),
        (F.col("caller_line") + F.col("l_linenumber")).alias("line"), (F.col("l_linenumber") * 4).cast("long").alias("column"),
    )


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(raw_calls(spark, sf_dir), nodes(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of schema.TABLES but the metadata."""
    found = resolved(spark, sf_dir)
    return {"nodes": nodes(spark, sf_dir), "files": files(spark, sf_dir), "raw_calls": raw_calls(spark, sf_dir), "edges": edges_of(found), "unresolved_refs": unresolved_of(found)}


#: Indexes by application, folder, state of the files that they are of, and what is in them.
_STORED: dict[tuple[str, ...], Store] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Changes when the tables that the graph is made of are written anew."""
    said = []
    for name in ("part", "lineitem"):
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = there.getFileSystem(spark._jsc.hadoopConfiguration())
        said += [files.getFileStatus(there).getModificationTime(), files.getContentSummary(there).getLength()]
    return ",".join(map(str, said))


def _stored(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[], dict[str, DataFrame]]) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), kind)
    if key not in _STORED:
        store = Store(spark, place(spark, kind))
        store.write(make(), {})
        _STORED[key] = store
    return _STORED[key]


def stored_graph(spark: SparkSession, sf_dir: str) -> Store:
    """nodes and edges as an index holds them: resolved once for each state of the tables, for questions that ask of the graph."""
    own = nodes(spark, sf_dir)
    return _stored(spark, sf_dir, "graph", lambda: {"nodes": own, "edges": edges_of(resolve(raw_calls(spark, sf_dir), own))})


def stored_texts(spark: SparkSession, sf_dir: str) -> Store:
    """nodes, postings and trigrams as an index holds them."""

    def make() -> dict[str, DataFrame]:
        own = cut(nodes(spark, sf_dir))
        return {"nodes": own, "postings": search.index_rows(own), "trigrams": trigrams.index_rows(own)}

    return _stored(spark, sf_dir, "texts", make)


def stored_impacts(spark: SparkSession, sf_dir: str) -> Store:
    """impacts and impact_blocks, of ``stored_texts``."""

    def make() -> dict[str, DataFrame]:
        texts = stored_texts(spark, sf_dir)
        mean = topk.mean_length(texts.table("postings"), texts.counts()["nodes"])
        rows = cut(topk.entries(texts.table("postings"), mean))
        return {"impacts": rows, "impact_blocks": topk.blocks(rows, mean)}

    return _stored(spark, sf_dir, "impacts", make)


PROJECTION_SQL = r"""
part_symbols AS (
  SELECT *, file_path || '::' || qualified_name AS id FROM (
    SELECT *, p_type || '::' || grp || '::' || brand || '::' || name AS qualified_name,
           (CASE WHEN p_type = 'PROMO' THEN 'tests/' ELSE 'src/' END) || lower(p_type) || '/' || lower(brand) || '.rs' AS file_path
    FROM (SELECT p_partkey, p_name, p_type, p_size, replace(p_brand, '#', '_') AS brand, CASE WHEN p_size % 2 = 0 THEN 'Even' ELSE 'Odd' END AS grp,
                 replace(p_name, ' ', '_') || CASE WHEN p_partkey % 10 = 0 THEN '_' || p_partkey ELSE '' END AS name FROM part))
), nodes AS (
  SELECT id, name, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' ELSE 'class' END AS kind, qualified_name, file_path,
         p_partkey * 10 + 1 AS start_line, p_partkey * 10 + 1 + p_size AS end_line, CAST(0 AS BIGINT) AS start_column, CAST(p_size % 40 AS BIGINT) AS end_column,
         'fn ' || name || '(' || lower(p_type) || ': ' || brand || ')' AS signature,
         CASE WHEN p_partkey % 3 <> 0 THEN '/// ' || p_name || ' for ' || lower(p_type) END AS doc_comment, starts_with(file_path, 'tests/') AS is_test
  FROM part_symbols QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_partkey DESC) = 1
), files AS (
  SELECT file_path, md5(file_path) AS content_hash, CASE length(file_path) % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'go' WHEN 2 THEN 'java' END AS language,
         CAST(sum(strlen(signature)) AS BIGINT) AS size_bytes, min(start_line) AS last_modified, bool_or(is_test) AS is_test
  FROM nodes GROUP BY file_path
), items AS (
  SELECT (l_orderkey + l_linenumber) % 8 AS k, a.id AS caller_id, a.p_partkey * 10 + 1 + l_linenumber AS line, CAST(l_linenumber * 4 AS BIGINT) AS col,
         b.p_type, b.grp, b.brand, b.name, b.file_path
  FROM lineitem JOIN part_symbols a ON a.p_partkey = l_partkey
  JOIN part_symbols b ON b.p_partkey = (l_orderkey * 7 + l_suppkey) % (SELECT count(*) FROM part)
), raw_calls AS (
  SELECT caller_id, CASE k WHEN 4 THEN brand || '::' || name WHEN 7 THEN 'missing_' || name ELSE name END AS callee_name,
         CASE k WHEN 7 THEN 'missing_' || name ELSE name END AS callee_simple, CASE k WHEN 4 THEN brand END AS callee_scope,
         CASE k WHEN 1 THEN 'method' WHEN 3 THEN 'function' END AS call_kind, CAST(NULL AS VARCHAR) AS receiver_expr,
         CASE WHEN k IN (1, 2) THEN brand END AS receiver_type, CASE k WHEN 3 THEN p_type END AS package_or_namespace,
         CASE WHEN k = 0 THEN p_type || '.' || grp || '.' || brand WHEN k IN (2, 5) THEN file_path END AS import_hint, line, col AS "column"
  FROM items
), syms AS (
  SELECT id, name, file_path, qualified_name AS qname, string_split(qualified_name, '::') AS seg FROM nodes
), calls AS (
  SELECT row_number() OVER () AS c, r.*, s.seg[-2] AS caller_ns, s.file_path AS caller_file FROM raw_calls r LEFT JOIN syms s ON s.id = r.caller_id
), candidates AS (
  SELECT c.*, s.id, s.file_path, s.seg,
         import_hint IS NOT NULL AND seg[-1] = callee_simple AND array_to_string(seg[1:-2], '|') = array_to_string(string_split(import_hint, '.'), '|') AS m_exact,
         receiver_type IS NOT NULL AND (array_to_string(seg[1:-2], '::') = receiver_type OR ends_with(array_to_string(seg[1:-2], '::'), '::' || receiver_type)) AS m_recv,
         import_hint IS NOT NULL AND (import_hint = '' OR regexp_matches(s.file_path, replace(replace(replace(import_hint, '.', '#'), '/', '[/]'), '#', '[./]'))) AS m_path,
         package_or_namespace IS NOT NULL AND seg[1] = package_or_namespace AS m_pkg,
         callee_scope IS NOT NULL AND ends_with(qname, callee_scope || '::' || callee_simple) AS m_scope,
         caller_ns IS NOT NULL AND seg[-2] = caller_ns AS m_ns, s.file_path = caller_file AS m_file
  FROM calls c JOIN syms s ON s.name = c.callee_simple
), counted AS (
  SELECT *, count(*) OVER w AS n, count(*) FILTER (m_exact) OVER w AS n_exact, count(*) FILTER (m_recv AND m_path) OVER w AS n_recv5,
         count(*) FILTER (m_recv) OVER w AS n_recv, count(*) FILTER (m_path) OVER w AS n_path, count(*) FILTER (m_pkg) OVER w AS n_pkg,
         count(*) FILTER (m_scope) OVER w AS n_scope, count(*) FILTER (m_ns) OVER w AS n_ns, count(*) FILTER (m_file) OVER w AS n_file
  FROM candidates WINDOW w AS (PARTITION BY c)
), staged AS (
  SELECT *, CASE WHEN n_exact = 1 THEN 'exact' WHEN n_recv5 = 1 OR (n_recv5 = 0 AND n_recv = 1) THEN 'receiver' WHEN n_path = 1 THEN 'imported' WHEN n_pkg = 1 THEN 'package'
                 WHEN n_scope = 1 THEN 'scope' WHEN n_ns = 1 THEN 'namespace_hit' WHEN n_file > 0 THEN 'same_file' WHEN n = 1 THEN 'named' ELSE 'unresolved' END AS stage
  FROM counted
), hits AS (
  SELECT c, caller_id, id, stage, CASE stage WHEN 'exact' THEN 5 WHEN 'receiver' THEN CASE WHEN n_recv5 = 1 THEN 5 ELSE 4 END WHEN 'namespace_hit' THEN 2 WHEN 'same_file' THEN 1
                                             WHEN 'named' THEN 0 ELSE 3 END AS res
  FROM staged WHERE CASE stage WHEN 'exact' THEN m_exact WHEN 'receiver' THEN m_recv AND (n_recv5 = 0 OR m_path) WHEN 'imported' THEN m_path WHEN 'package' THEN m_pkg
                               WHEN 'scope' THEN m_scope WHEN 'namespace_hit' THEN m_ns WHEN 'same_file' THEN m_file WHEN 'named' THEN true ELSE false END
), edges AS (
  SELECT caller_id AS source_id, id AS target_id, 'calls' AS kind, CAST(max(res) AS INTEGER) AS resolution_kind FROM hits GROUP BY ALL
), unresolved_refs AS (
  SELECT caller_id AS source_id, callee_name AS specifier, 'calls' AS kind, line, "column" FROM calls WHERE c NOT IN (SELECT c FROM hits)
)
"""


def sql(query: str) -> str:
    """``query`` over the projection; it may have a WITH clause of its own."""
    query = query.strip()
    if query.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {PROJECTION_SQL.strip()}, {query.removeprefix('WITH RECURSIVE ')}"
    if query.startswith("WITH "):
        return f"WITH {PROJECTION_SQL.strip()}, {query.removeprefix('WITH ')}"
    return f"WITH {PROJECTION_SQL.strip()}\n{query}"
