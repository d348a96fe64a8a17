"""A workspace as a data source: ``spark.read.format("workspace").load(folder)`` gives its source files.

The driver lists paths alone and deals them out by bytes; executors read. Filters on file_path and language reach the
list, so a question for a few files reads those and walks no folder.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from callweave.sources import scan

SCHEMA = "file_path string, language string, size_bytes long, last_modified long, is_test boolean, content string, content_hash string"
#: With it Spark asks Python sources which filters they take.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Paths that a question names in a filter; more are joined to the whole workspace.
NAMED = 1_000


@dataclass
class Files(InputPartition):
    """path, language, size, time of modification."""

    files: list[tuple[str, str, int, int]]


def dealt(files: list[tuple[str, str, int, int]], parts: int) -> list[list[tuple[str, str, int, int]]]:
    """The files in ``parts`` lists of about as many bytes: the largest first, each to the list that has least."""
    heap = [(0, 0, k) for k in range(parts)]
    out: list[list] = [[] for _ in range(parts)]
    for f in sorted(files, key=lambda f: (-f[2], f[0])):
        size, n, k = heapq.heappop(heap)
        out[k].append(f)
        heapq.heappush(heap, (size + f[2], n + 1, k))
    return [x for x in out if x]


class WorkspaceReader(DataSourceReader):
    def __init__(self, folder: str, include_library: bool, task_bytes: int):
        self.folder, self.include_library, self.task_bytes = folder, include_library, task_bytes
        self.paths: set[str] | None = None
        self.prefixes: list[str] = []
        self.languages: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(("file_path",), str(value)):
                    self._only({value})
                case In(("file_path",), values):
                    self._only({v for v in values if v is not None})
                case StringStartsWith(("file_path",), value):
                    self.prefixes.append(value)
                case EqualTo(("language",), str(value)):
                    self.languages.append(value)
                case _:
                    yield f

    def _only(self, paths: set[str]) -> None:
        self.paths = paths if self.paths is None else self.paths & paths

    def listed(self) -> list[tuple[str, str, int, int]]:
        """The files that the filters leave; without a walk if they name them."""
        if self.paths is None:
            found = scan.list_files(self.folder, self.include_library)
        else:
            found = [f for p in sorted(self.paths) if (f := one_file(self.folder, p, self.include_library))]
        return [f for f in found if all(f[0].startswith(p) for p in self.prefixes) and all(f[1] == x for x in self.languages)]

    def partitions(self) -> list[Files]:
        found = self.listed()
        parts = max(1, min(len(found), 10_000, max(8, -(-sum(f[2] for f in found) // self.task_bytes))))
        return [Files(x) for x in dealt(found, parts)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, language, size, modified in partition.files:
            text = text_of(self.folder, path)
            yield path, language, size, modified, scan.is_test_path(path), text, None if text is None else hashlib.md5(text.encode()).hexdigest()


def one_file(folder: str, path: str, include_library: bool) -> tuple[str, str, int, int] | None:
    """path, language, size, time of a file that a scan would list; None for others."""
    parts = path.split("/")
    full = os.path.join(folder, path)
    if any(scan.skips(d, include_library) or d in ("", ".", "..") for d in parts[:-1]) or not (language := scan.language_for(path)) or not os.path.isfile(full):
        return None
    stat = os.stat(full)
    return path, language, stat.st_size, int(stat.st_mtime)


def text_of(folder: str, path: str) -> str | None:
    """None if the file can't be read as UTF-8."""
    try:
        with open(os.path.join(folder, path), "rb") as f:
            return f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


class Workspace(DataSource):
    """Options: path, the folder, which all machines see; includeLibrary; taskBytes, what a task reads, about."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options["path"], self.options.get("includeLibrary", "false").lower() == "true", int(self.options.get("taskBytes", scan.TASK_BYTES)))


def files(spark: SparkSession, folder: str, include_library: bool = False) -> DataFrame:
    """The source files of a workspace, as ``scan.scan`` gives them, by the data source."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Workspace)
    return spark.read.format("workspace").option("includeLibrary", str(include_library).lower()).load(folder)


def named(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """The files of ``paths`` (file_path), those of libraries too; a few are named to the source, so that no other is read."""
    wanted = paths.select("file_path").distinct()
    few = [r["file_path"] for r in wanted.limit(NAMED + 1).collect()]
    found = files(spark, folder, True)
    return found.where(F.col("file_path").isin(few)) if len(few) <= NAMED else found.join(wanted, "file_path", "left_semi")
