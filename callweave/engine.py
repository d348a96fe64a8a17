"""The engine: build and sync an index of a workspace, and ask it."""

from __future__ import annotations

import inspect
import json
import logging
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import schema
from callweave.operators import lookup, report, resolve, search, sync, trigrams
from callweave.plans.cut import cut
from callweave.sources import scan, workspace
from callweave.sources.parsers import calls_of, nodes_of, parsed
from callweave.sources.store import IndexMissing, Manifest, Store

log = logging.getLogger(__name__)
#: The file beside the tables that tells tools and people what the index is of.
POINTER = "ABOUT.md"


class Engine:
    """An index of one workspace. Results are DataFrames; ``workspace`` must be visible to all executors."""

    def __init__(self, spark: SparkSession, workspace: str, index: str | None = None):
        """``index``: the folder of the index, on any storage that Spark can write; without it, one within the workspace."""
        self.spark, self.workspace = spark, str(workspace)
        self.store = Store(spark, index or str(Path(workspace, scan.INDEX_DIR).absolute()))

    # -- building

    def build(self, include_library: bool = False) -> None:
        """A fresh index. Each file is read and parsed once."""
        found = cut(parsed(scan.scan(self.spark, self.workspace, include_library)))
        self._warn(found)
        nodes = cut(nodes_of(found))
        calls = sync.known_ends(calls_of(found), nodes, "caller_id")
        calls = cut(calls.select(*schema.names(schema.RAW_CALLS)))
        resolved = cut(resolve.resolve(calls, nodes).select(*resolve.FOUND))
        self._say(self.store.write({
            "files": found.where("content_hash is not null"), "nodes": nodes, "raw_calls": calls,
            "edges": sync.known_ends(resolve.edges_of(resolved), nodes, "source_id", "target_id"),
            "unresolved_refs": sync.known_ends(resolve.unresolved_of(resolved), nodes, "source_id"), "postings": search.index_rows(nodes), "trigrams": trigrams.index_rows(nodes),
        }, self._facts()))

    def sync(self, include_library: bool = False) -> None:
        """Bring the index up to date: only changed files are parsed, only calls that they touch resolved anew.

        A file that can't be read as UTF-8 any more keeps what the index has of it.
        """
        now = self.store.manifest
        if now is None:
            raise IndexMissing(f"no index in {self.workspace}; build one first")
        if now.schema_version != schema.SCHEMA_VERSION:
            return self.build(include_library)
        before = self._tables()
        listed = cut(scan.scan(self.spark, self.workspace, include_library).select(*schema.names(schema.FILES)))
        self._warn(listed)
        changed = sync.modified(before["files"], listed).select("file_path")
        found = cut(parsed(scan.scan(self.spark, self.workspace, include_library, changed)))
        # what was parsed is what counts, should a file have changed in between
        disk = cut(listed.join(found.select("file_path"), "file_path", "left_anti").unionByName(found.select(*listed.columns)))
        return self._change(before, disk, found)

    def apply(self, seen: DataFrame) -> None:
        """Bring the index up to date with files that are known to have changed, and no others.

        ``seen``: the columns of a scan, and gone. Files that the index has like this are left alone.
        """
        seen = cut(seen)
        if seen.isEmpty():
            return None
        before = self._tables()
        found = cut(parsed(seen.where("not gone")))
        others = before["files"].join(seen.select("file_path"), "file_path", "left_anti")
        return self._change(before, others.unionByName(found.select(*others.columns)), found)

    def _tables(self) -> dict[str, DataFrame]:
        return {t: self.store.table(t) for t in ("files", "nodes", "raw_calls", "edges", "unresolved_refs")}

    def _change(self, before: dict[str, DataFrame], disk: DataFrame, found: DataFrame) -> None:
        """Append what ``disk`` (files) and ``found`` (what was parsed of them) make different."""
        after = sync.changes(before, {"files": disk, "nodes": nodes_of(found), "raw_calls": calls_of(found)})
        gone, new = sync.symbols_changed(after, before)
        after |= {"postings": (gone, search.index_rows(new)), "trigrams": (gone, trigrams.index_rows(new))}
        return self._say(self.store.append(after, self._facts()))

    def compact(self) -> None:
        """Rewrite the tables in as few files as they need."""
        self.store.compact()

    def _warn(self, files: DataFrame) -> None:
        for r in files.where("content_hash is null").select("file_path").limit(20).collect():
            log.warning("not readable as UTF-8, left as it was: %s", r["file_path"])

    def _facts(self) -> dict[str, str | None]:
        return scan.git_facts(self.workspace) | {"indexed_at": datetime.now(UTC).isoformat(timespec="seconds")}

    def _say(self, written: Manifest) -> None:
        """Tell what has been written, as it was counted in writing."""
        log.info("version %d: %s", written.version, ", ".join(f"{sum(s.rows for s in found)} {t} in {len(found)} segments, {sum(s.gone for s in found)} keys replaced" for t, found in written.tables.items()))
        said = "".join(f"- {name}: {written.facts[key] or 'N/A'}\n" for name, key in (("commit", "git_commit_sha"), ("branch", "git_branch"), ("working tree", "git_status"), ("indexed at", "indexed_at")))
        self.store.put_text(POINTER, f"# Code graph of this workspace\n\nWritten by each build and sync.\n\n{said}\nAsk it with callweave.engine.Engine; status() says whether it is fresh.\n")

    # -- asking

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def status(self) -> DataFrame:
        """One row: counts, freshness, schema, verdict and what to do."""
        facts = {r["key"]: r["value"] for r in self.table("project_metadata").collect()}
        live = scan.git_facts(self.workspace)
        row = (self.store.manifest.schema_version, facts.get("git_commit_sha"), live["git_commit_sha"], facts.get("git_status"), live["git_status"], facts.get("indexed_at"))
        given = self.spark.createDataFrame([row], "found_schema int, indexed_sha string, head_sha string, indexed_status string, live_status string, indexed_at string")
        return report.status(report.totals(self.table("files"), self.table("nodes"), self.table("edges")), given, schema.SCHEMA_VERSION)

    def files(self) -> DataFrame:
        return lookup.files_with_counts(self.table("files"), self.table("nodes"))

    def search(self, query: str, limit: int = 30, no_tests: bool = False) -> DataFrame:
        return search.search(self.table("nodes"), query, limit, no_tests, self.table("postings"), self.table("trigrams"))

    def _targets(self, symbol: str, within: str | None, no_tests: bool) -> DataFrame:
        return lookup.scoped(lookup.without_tests(lookup.find_symbol(self.table("nodes"), symbol), no_tests), within)

    def callers(self, symbol: str, min_confidence: int = 0, within: str | None = None, no_tests: bool = False) -> DataFrame:
        return lookup.callers(self._targets(symbol, within, no_tests), self.table("edges"), self.table("nodes"), None, min_confidence, no_tests)

    def callees(self, symbol: str, min_confidence: int = 0, within: str | None = None, no_tests: bool = False) -> DataFrame:
        return lookup.callees(self._targets(symbol, within, no_tests), self.table("edges"), self.table("nodes"), None, min_confidence, no_tests)

    def contents(self, paths: DataFrame) -> DataFrame:
        """file_path, content of those files as they are on disk."""
        return workspace.named(self.spark, self.workspace, paths).select("file_path", "content")

    def node(self, symbol: str | None = None, file: str | None = None, line: int | None = None, offset: int | None = None, limit: int | None = None, symbols_only: bool = False, no_tests: bool = False) -> dict[str, DataFrame]:
        """Of a symbol: nodes, code, callers, callees. Of a file: nodes, dependents, and lines unless ``symbols_only``."""
        if (symbol is None) == (file is None):
            raise ValueError("give a symbol or a file")
        nodes, edges = self.table("nodes"), self.table("edges")
        if file is not None:
            out = {"nodes": lookup.file_symbols(nodes, file), "dependents": lookup.dependents(file, edges, nodes)}
            if not symbols_only:
                out["lines"] = lookup.file_slice(self.contents(nodes.where(F.col("file_path") == file)), offset, limit)
            return out
        found = lookup.find_symbol(nodes, symbol)
        found = lookup.without_tests(found if line is None else lookup.at_line(found, line), no_tests)
        return self._details(found, no_tests)

    def _details(self, found: DataFrame, no_tests: bool) -> dict[str, DataFrame]:
        nodes, edges = self.table("nodes"), self.table("edges")
        return {
            "nodes": found, "code": lookup.code_lines(found, self.contents(found)),
            "callers": lookup.callers(found, edges, nodes, no_tests=no_tests), "callees": lookup.callees(found, edges, nodes, no_tests=no_tests),
        }

    def explore(self, query: str, no_tests: bool = False) -> dict[str, DataFrame]:
        """Symbols that a query finds, by file and rank, with code, callers and callees."""
        found = lookup.without_tests(search.ladder(self.table("nodes"), query, self.table("postings"), self.table("trigrams")), no_tests)
        return self._details(found.orderBy("file_path", "rank", "id"), no_tests)

    def pull_report(self, pull: str, changed: str, k: int = 12) -> DataFrame:
        """A report on a pull request from two JSON files: the request itself, and its changed files."""
        read = lambda path, ddl: report.read_json(self.spark.read.text(path, wholetext=True), ddl)
        counts = report.totals(self.table("files"), self.table("nodes"), self.table("edges"))
        return report.pull_report(read(pull, report.PULL), read(changed, report.CHANGED), counts, self.table("nodes"), scan.is_shallow(self.workspace), k)

    def as_json(self, found: DataFrame | dict[str, DataFrame]) -> str:
        """What any of the others found, as indented JSON. For results that a reader can take in."""
        rows = lambda df: [json.loads(r["json"]) for r in report.as_json(df).collect()]
        return json.dumps(rows(found) if isinstance(found, DataFrame) else {name: rows(df) for name, df in found.items()}, indent=2, ensure_ascii=False)

    def as_text(self) -> str:
        """The files as a table of fixed widths."""
        return "\n".join(r["line"] for r in report.files_as_text(self.files()).collect())

    def describe(self) -> dict[str, dict[str, object]]:
        """What can be asked: for each question what it is, and its arguments with their defaults."""
        out = {}
        for name in ("build", "sync", "compact", "status", "files", "search", "callers", "callees", "node", "explore", "pull_report", "as_json", "as_text"):
            about = inspect.signature(getattr(self, name)).parameters
            out[name] = {"about": (getattr(Engine, name).__doc__ or name).strip().split("\n")[0], "arguments": {k: None if p.default is p.empty else p.default for k, p in about.items()}}
        return out
