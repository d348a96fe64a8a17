"""Symbol lookups, callers and callees, files and lines, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.columns import confidence, folded, like_pattern, resolution_label
from callweave.plans.cut import cut


def find_nodes(nodes: DataFrame, name: str | None = None, kind: str | None = None, file_path: str | None = None) -> DataFrame:
    for column, value in (("name", name), ("kind", kind), ("file_path", file_path)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes


def find_by_id(nodes: DataFrame, symbol: str) -> DataFrame:
    return nodes.where((F.col("id") == symbol) | (F.col("qualified_name") == symbol))


def find_like(nodes: DataFrame, query: str) -> DataFrame:
    """Name, qualified name or id contain the query, in which % and _ are wildcards; ASCII letters are folded."""
    pattern = like_pattern(query)
    like = lambda c: folded(F.col(c)).like(pattern)
    return nodes.where(like("name") | like("qualified_name") | like("id"))


def without_tests(nodes: DataFrame, no_tests: bool) -> DataFrame:
    return nodes.where(~F.col("is_test")) if no_tests else nodes


def first_found(*branches: DataFrame) -> DataFrame:
    """The first branch that has a row, as one plan: the branches are tagged and those of the least tag stay."""
    tagged = [b.withColumn("__step", F.lit(k)) for k, b in enumerate(branches)]
    both = tagged[0]
    for b in tagged[1:]:
        both = both.unionByName(b)
    least = both.agg(F.min("__step").alias("__least"))
    return both.join(F.broadcast(least), F.col("__step") == F.col("__least")).drop("__step", "__least")


def find_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """By name, or else by id or qualified name."""
    return first_found(find_nodes(nodes, name=symbol), find_by_id(nodes, symbol))


def scoped(nodes: DataFrame, prefix: str | None) -> DataFrame:
    """Symbols whose path starts with ``prefix``, in the middle of a segment too."""
    return nodes if prefix is None else nodes.where(F.startswith("file_path", F.lit(prefix)))


#: Ids of a question that go into the filter of the scan; more are joined.
IDS = 200


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is one of ``ids`` (id).

    A few ids are fetched and become a filter that reaches the scan: where the rows lie in the column's order, the files
    and row groups that can't hold them aren't read.
    """
    ids = ids.select(F.col("id").alias(column)).distinct()
    few = [r[0] for r in ids.limit(IDS + 1).collect()]
    return rows.where(F.col(column).isin(few)) if len(few) <= IDS else rows.join(ids, column, "left_semi")


def _related(targets: DataFrame, edges: DataFrame, nodes: DataFrame, own: str, other: str, kind: str | None, min_confidence: int, no_tests: bool) -> DataFrame:
    rows = edges if kind is None else edges.where(F.col("kind") == kind)
    hits = among(rows, own, targets).select(F.col(other).alias("id"), confidence(F.col("resolution_kind")).alias("confidence"), "resolution_kind")
    hits = hits.where(F.coalesce("confidence", F.lit(0)) >= min_confidence)
    best = hits.groupBy("id").agg(F.max(F.struct("confidence", "resolution_kind")).alias("best"))
    found = without_tests(nodes.join(best, "id"), no_tests)
    out = found.select(*nodes.columns, resolution_label(F.col("best.resolution_kind")).alias("resolution"), F.col("best.confidence").alias("confidence"))
    return out.orderBy(F.desc("confidence"), "id")


def callers(targets: DataFrame, edges: DataFrame, nodes: DataFrame, kind: str | None = None, min_confidence: int = 0, no_tests: bool = False) -> DataFrame:
    """Who calls any of ``targets``: each once, with its surest edge, surest first."""
    return _related(targets, edges, nodes, "target_id", "source_id", kind, min_confidence, no_tests)


def callees(sources: DataFrame, edges: DataFrame, nodes: DataFrame, kind: str | None = None, min_confidence: int = 0, no_tests: bool = False) -> DataFrame:
    """Whom any of ``sources`` calls."""
    return _related(sources, edges, nodes, "source_id", "target_id", kind, min_confidence, no_tests)


def dependents(file_path: str, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols of other files that call into the file."""
    inside = nodes.where(F.col("file_path") == file_path)
    return callers(inside, edges, nodes).where(F.col("file_path") != file_path)


def file_symbols(nodes: DataFrame, file_path: str) -> DataFrame:
    return find_nodes(nodes, file_path=file_path).orderBy("start_line", "id")


def files_with_counts(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every file and the number of its symbols."""
    counts = nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))
    out = files.join(counts, "file_path", "left")
    return out.select("file_path", "language", "size_bytes", "is_test", F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols")).orderBy("file_path")


def at_line(nodes: DataFrame, line: int) -> DataFrame:
    return nodes.where(F.lit(line).between(F.col("start_line"), F.col("end_line")))


def text_lines(content: Column) -> Column:
    """Lines without their ends; what follows the last line feed is a line only if there is something."""
    lines = F.split(content, "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.transform(lines, lambda x: F.regexp_replace(x, r"\r$", ""))


def code_lines(spans: DataFrame, contents: DataFrame) -> DataFrame:
    """id, line, text of the lines of each symbol's span. ``contents``: file_path, content."""
    joined = spans.select("id", "file_path", "start_line", "end_line").join(contents, "file_path")
    each = joined.select("id", "start_line", "end_line", F.posexplode(text_lines(F.col("content"))).alias("pos", "text"))
    line = F.col("pos").cast("long") + 1
    return each.where(line.between(F.greatest("start_line", F.lit(1)), F.col("end_line"))).select("id", line.alias("line"), "text")


def file_slice(contents: DataFrame, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """file_path, line, text from line ``offset`` to line ``offset + limit``, that one included."""
    start = max(offset or 1, 1)
    each = contents.select("file_path", F.posexplode(text_lines(F.col("content"))).alias("pos", "text"))
    line = F.col("pos").cast("long") + 1
    keep = line >= start if limit is None else line.between(start, start + limit)
    return each.where(keep).select("file_path", line.alias("line"), "text")


def cross_file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    s = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("file_path").alias("source_file"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("file_path").alias("target_file"))
    return edges.join(s, "source_id").join(t, "target_id").where("source_file <> target_file")


def k_hop_callers(target: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """id and the least number of calls, up to ``depth``, by which a symbol reaches ``target``. An extension.

    Each rim is stored, so that its size is known before the edges, which are many more, are moved to meet it.
    """
    rim = reached = cut(target.select("id", F.lit(0).alias("hops")).distinct())
    for k in range(1, depth + 1):
        step = edges.join(rim.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        rim = cut(step.join(reached, "id", "left_anti").withColumn("hops", F.lit(k)))
        reached = reached.unionByName(rim)
    return reached


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Keys that only one of two snapshots has. An extension."""
    added = after.select(key).join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select(key).join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed")))
