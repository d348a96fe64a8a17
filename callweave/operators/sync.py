"""Incremental maintenance: what a changed workspace means for the tables of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.columns import simple_name
from callweave.operators.resolve import FOUND, edges_of, resolve, unresolved_of
from callweave.plans.cut import cut


def pruned(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Indexed files that are gone."""
    return indexed.join(on_disk.select("file_path"), "file_path", "left_anti")


def modified(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Files on disk that are new or differ in hash, time or size; of those without a hash, which can't be read, none."""
    old = indexed.select("file_path", F.struct("content_hash", "last_modified", "size_bytes").alias("old"))
    same = F.struct("content_hash", "last_modified", "size_bytes").eqNullSafe(F.col("old"))
    return on_disk.join(old, "file_path", "left").where(~same & F.col("content_hash").isNotNull()).drop("old")


def known_ends(edges: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """Rows all of whose ``ends`` are symbols."""
    for end in ends:
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def calls_once(calls: DataFrame) -> DataFrame:
    """One of the raw calls of a caller at a place with a callee's name: the first by its other columns."""
    place = ["caller_id", "callee_name", "line", "column"]
    other = [c for c in calls.columns if c not in place]
    first = calls.groupBy(*place).agg(F.min(F.struct(*other)).alias("first"))
    return first.select(*[F.col(f"first.{c}") if c in other else F.col(c) for c in calls.columns])


def replaced(rows: DataFrame, gone: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """``rows`` without those of the keys in ``gone``, and ``new``."""
    return rows.join(gone, key, "left_anti").unionByName(new.select(*rows.columns))


def changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What a sync does to each table: the keys whose rows go, and the rows that come. ``after`` as in ``apply_changes``.

    Resolved anew are the calls of changed files, calls of names that a changed file has or had, and unresolved
    references to such names. Calls find symbols by name alone, so only symbols of the names called are candidates, and
    every edge to a symbol that goes is among those resolved anew. Both keep the work to what the change touches.
    """
    gone = pruned(before["files"], after["files"]).select("file_path")
    new_files = cut(modified(before["files"], after["files"]))
    changed = cut(gone.union(new_files.select("file_path")).distinct())
    old_nodes = before["nodes"].join(changed, "file_path", "left_semi")
    new_nodes = cut(after["nodes"].join(new_files.select("file_path"), "file_path", "left_semi"))
    old_ids = cut(old_nodes.select("id", "name"))
    touched = old_ids.union(new_nodes.select("id", "name"))
    names = cut(touched.select(F.col("name").alias("simple")).distinct())
    nodes = replaced(before["nodes"], changed, new_nodes)
    new_calls = cut(after["raw_calls"].join(new_nodes.select(F.col("id").alias("caller_id")), "caller_id", "left_semi"))
    gone_callers = old_ids.select(F.col("id").alias("caller_id"))
    calls = replaced(before["raw_calls"], gone_callers, new_calls, "caller_id")
    simple = F.coalesce("callee_simple", simple_name(F.col("callee_name")))
    by_name = calls.withColumn("simple", simple).join(names, "simple", "left_semi").select("caller_id")
    refs = before["unresolved_refs"].withColumn("simple", simple_name(F.col("specifier"))).join(names, "simple", "left_semi").select(F.col("source_id").alias("caller_id"))
    affected = cut(touched.select(F.col("id").alias("caller_id")).union(by_name).union(refs).distinct())
    again = cut(calls.join(affected, "caller_id", "left_semi").distinct())
    called = again.select(simple_name(F.col("callee_name")).alias("name")).distinct()
    candidates = nodes.join(called, "name", "left_semi").unionByName(nodes.join(affected.select(F.col("caller_id").alias("id")), "id", "left_semi").select(*nodes.columns))
    found = cut(resolve(again, cut(candidates.dropDuplicates(["id"]))).select(*FOUND))
    sources = affected.select(F.col("caller_id").alias("source_id"))
    callers = candidates.select("id").distinct()
    return {
        "files": (changed, new_files), "nodes": (changed, new_nodes), "raw_calls": (gone_callers, new_calls),
        "edges": (sources, known_ends(edges_of(found), callers, "source_id")), "unresolved_refs": (sources, known_ends(unresolved_of(found), callers, "source_id")),
    }


def symbols_changed(of: dict[str, tuple[DataFrame, DataFrame]], before: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Ids of the symbols that a change takes away, and the symbols that it brings."""
    changed, new = of["nodes"]
    return before["nodes"].join(changed, "file_path", "left_semi").select("id"), new


def apply_changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a sync. ``after``: files on disk, and nodes and raw_calls of the modified ones (others are ignored).

    That gives the edges of a fresh build, so raw calls at one place that differ in a receiver or hint are all resolved.
    """
    return {t: replaced(before[t], gone, new, gone.columns[0]) for t, (gone, new) in changes(before, after).items()}
