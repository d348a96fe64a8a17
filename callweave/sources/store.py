"""Tables of a graph on shared storage, log-structured: segments of rows, tombstones, and a manifest for each version.

A table is a list of segments. A segment holds rows, and the keys that it takes from the segments before it (its
tombstones). A change is a further segment, so what it writes follows the change and not the table. Readers see the
version whose manifest is the last; a manifest appears at once or not at all, and of two writers that began from one
version the later fails. A table with many segments has the newest of them merged, by size: a segment is merged with
what came after it only if that is about as large, so every row is rewritten a logarithmic number of times.

All access goes through Hadoop's file systems, so the folder may be any that Spark can write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callweave import schema


class IndexMissing(FileNotFoundError):
    """There is no index in the workspace yet."""


class StoreChanged(RuntimeError):
    """Another writer has written the version that this one was about to write."""


#: Segments of a table before its newest are merged.
SEGMENTS = 6
#: A segment is merged with those after it if it is at most so many times as large as they are together.
RATIO = 2
#: Tombstones that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_KEYS = 500_000
#: What a table's rows are replaced by, and how they lie within a file.
KEYS = {"files": "file_path", "nodes": "file_path", "raw_calls": "caller_id", "edges": "source_id", "unresolved_refs": "source_id", "postings": "id", "trigrams": "id", "impacts": "id", "impact_blocks": "term"}
ORDER = {"nodes": ["name", "id"], "edges": ["target_id", "source_id"], "raw_calls": ["callee_simple"], "postings": ["term", "id"], "trigrams": ["gram", "id"], "impacts": ["term", "block", "shard"], "impact_blocks": ["term", "block"]}
#: Columns that rows are looked up by and don't lie in the order of: their row groups have Bloom filters for so many values.
BLOOM = {"nodes": ["id", "qualified_name"], "edges": ["source_id"]}
BLOOM_VALUES = 100_000


@dataclass(frozen=True)
class Segment:
    """rows and gone: how many rows and tombstones; size: bytes of both."""

    name: str
    rows: int
    gone: int
    size: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema_version: int
    facts: dict[str, str | None]
    tables: dict[str, tuple[Segment, ...]]

    def as_text(self) -> str:
        return json.dumps(asdict(self), indent=1, ensure_ascii=False)

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["schema_version"], d["facts"], {t: tuple(Segment(**s) for s in found) for t, found in d["tables"].items()})


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/") if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    # -- files

    def _path(self, place: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_text(self, place: str, text: str) -> None:
        out = self._files().create(self._path(place), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, place: str) -> str:
        found = self._files().open(self._path(place))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()

    def _names(self, place: str) -> list[str]:
        return [s.getPath().getName() for s in self._files().listStatus(self._path(place))] if self._files().exists(self._path(place)) else []

    def put_text(self, place: str, text: str) -> None:
        """A file beside the tables."""
        self._write_text(place, text)

    # -- versions

    @property
    def manifest(self) -> Manifest | None:
        """The last version; None without an index."""
        versions = [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]
        return Manifest.of(self._read_text(f"manifests/{max(versions):010d}.json")) if versions else None

    def _current(self) -> Manifest:
        found = self.manifest
        if found is None:
            raise IndexMissing(f"no index in {self.folder}; build one first")
        return found

    def _commit(self, new: Manifest, before: Manifest | None) -> None:
        """Make ``new`` the last version, and delete what neither it nor the one before needs: open readers have that."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        temp, place = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{new.version:010d}.json")
        self._write_text(f"manifests/{temp.getName()}", new.as_text())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # fails if the version is there
            context.rename(temp, place, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._files().delete(temp, False)
            if self._files().exists(place):
                raise StoreChanged(f"version {new.version} of {self.folder} has been written by another") from e
            raise
        needed = {(t, s.name) for m in (new, before) if m for t, found in m.tables.items() for s in found}
        older = sorted(n for n in self._names("manifests") if n.endswith(".json"))[:-2]
        for name in older:
            for t, found in Manifest.of(self._read_text(f"manifests/{name}")).tables.items():
                for s in found:
                    if (t, s.name) not in needed:
                        self._files().delete(self._path(f"{t}/{s.name}"), True)
            self._files().delete(self._path(f"manifests/{name}"), False)

    # -- reading

    def table(self, name: str) -> DataFrame:
        found = self._current()
        if name == "project_metadata":
            return self.spark.createDataFrame(list(found.facts.items()), schema.METADATA)
        return self._rows(name, found.tables[name])

    def counts(self) -> dict[str, int] | None:
        """Rows of each table by the manifest; None for a table of which tombstones may have taken some."""
        return {t: None if any(s.gone for s in found) else sum(s.rows for s in found) for t, found in self._current().tables.items()}

    def _rows(self, name: str, segments: tuple[Segment, ...]) -> DataFrame:
        """The rows of ``segments`` but those that a later one of them has tombstones for."""
        key = KEYS[name]
        read = lambda s: self.spark.read.schema(schema.TABLES[name]).parquet(f"{self.folder}/{name}/{s.name}/rows")
        full = [(k, s) for k, s in enumerate(segments) if s.rows]
        if not full:
            return self.spark.createDataFrame([], schema.TABLES[name])
        gone = [(k, s) for k, s in enumerate(segments) if s.gone and k > full[0][0]]
        if not gone:
            return reduce(DataFrame.unionAll, [read(s) for _, s in full])
        rows = reduce(DataFrame.unionAll, [read(s).withColumn("__segment", F.lit(k)) for k, s in full])
        taken = reduce(DataFrame.unionAll, [self._gone(name, s).withColumn("__by", F.lit(k)) for k, s in gone])
        taken = taken.groupBy("__key").agg(F.max("__by").alias("__by"))
        taken = F.broadcast(taken) if sum(s.gone for _, s in gone) <= BROADCAST_KEYS else taken
        return rows.join(taken, (F.col(key) == F.col("__key")) & (F.col("__segment") < F.col("__by")), "left_anti").select(*schema.names(schema.TABLES[name]))

    def _gone(self, name: str, segment: Segment) -> DataFrame:
        return self.spark.read.schema("__key string").parquet(f"{self.folder}/{name}/{segment.name}/gone")

    # -- writing

    def _segment(self, name: str, rows: DataFrame, gone: DataFrame | None, whole: bool) -> Segment:
        """A new segment; rows and tombstones are counted as they are written."""
        own = f"seg-{uuid.uuid4().hex}"
        place, seen, order = f"{self.folder}/{name}/{own}", Observation(), ORDER.get(name)
        rows = rows.select(*schema.names(schema.TABLES[name]))
        if order and whole:  # ranges, so that a value's rows are in few files and their footers rule the others out
            rows = rows.repartitionByRange(*order)
        elif not whole:
            rows = rows.hint("rebalance")
        rows = rows.sortWithinPartitions(*order) if order else rows
        # observed last: what samples the ranges would be counted too
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write
        for column in BLOOM.get(name, []) if whole else []:  # a change is small, and such a filter isn't
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_VALUES))
        writer.parquet(f"{place}/rows")
        n, taken = seen.get["n"], 0
        if gone is not None:
            counted = Observation()
            gone.select(F.col(gone.columns[0]).alias("__key")).dropna().distinct().hint("rebalance").observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{place}/gone")
            taken = counted.get["n"]
        return Segment(own, n, taken, self._files().getContentSummary(self._path(f"{name}/{own}")).getLength())

    def write(self, tables: dict[str, DataFrame], facts: dict[str, str | None]) -> Manifest:
        """All tables anew, a segment for each."""
        before = self.manifest
        found = {t: (self._segment(t, rows, None, True),) for t, rows in tables.items()}
        new = Manifest(before.version + 1 if before else 1, schema.SCHEMA_VERSION, facts, found)
        self._commit(new, before)
        return new

    def append(self, changes: dict[str, tuple[DataFrame, DataFrame]], facts: dict[str, str | None]) -> Manifest:
        """A change of each table: the keys that it takes away, and the rows that it brings. Nothing is written for none."""
        before = self._current()
        tables = dict(before.tables)
        for name, (gone, rows) in changes.items():
            new = self._segment(name, rows, gone, False)
            if new.rows or new.gone:
                tables[name] = (*tables[name], new)
            else:
                self._files().delete(self._path(f"{name}/{new.name}"), True)
        tables = {t: self._merged(t, found) for t, found in tables.items()}
        after = replace(before, version=before.version + 1, facts=facts, tables=tables)
        self._commit(after, before)
        return after

    def _merged(self, name: str, segments: tuple[Segment, ...]) -> tuple[Segment, ...]:
        """``segments``, the newest merged into one if there are too many."""
        if len(segments) <= SEGMENTS:
            return segments
        first = len(segments) - 2
        while first and segments[first - 1].size <= RATIO * sum(s.size for s in segments[first:]):
            first -= 1
        return (*segments[:first], self._merge(name, segments[first:], first == 0))

    def _merge(self, name: str, run: tuple[Segment, ...], oldest: bool) -> Segment:
        """``run`` as one segment. Its tombstones stay, unless there is nothing before it that they could take."""
        gone = None if oldest else reduce(DataFrame.unionAll, [self._gone(name, s) for s in run if s.gone], self.spark.createDataFrame([], "__key string"))
        return self._segment(name, self._rows(name, run), gone, oldest)

    def compact(self) -> Manifest:
        """Each table as one segment, without tombstones."""
        before = self._current()
        tables = {t: found if len(found) == 1 else (self._merge(t, found, True),) for t, found in before.tables.items()}
        after = replace(before, version=before.version + 1, tables=tables)
        self._commit(after, before)
        return after
