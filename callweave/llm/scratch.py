"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``, and broadcasts that can be let go.

An operator that would otherwise compute something twice, or iterate, writes it once as Parquet and reads it back. That
cuts lineage and survives the loss of executors, because every machine sees the folder. What an operator no longer
needs it drops; the rest goes with the application.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Bits of a filter for each key, its pieces (bits of one, as bitmap_construct_agg has them), and the most of these: 16 MB.
FILTER_BITS, PIECE, PIECES = 16, 32_768, 4_096
#: Whether the shuffle files of a query go at its end.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: What each owner has made: paths and broadcasts.
_MADE: dict[str, list[str | Broadcast]] = {}
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


def folder(spark: SparkSession) -> str:
    """The shared folder. Where none is configured a local session, as in tests, gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="callweave-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, until the application ends."""
    found = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, there = _at(spark, found)
    files.deleteOnExit(there)
    return found


def exists(spark: SparkSession, place: str) -> bool:
    files, there = _at(spark, place)
    return files.exists(there)


def table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back; ``keep``: not to be deleted with its owner's other tables.

    What was shuffled for it goes as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, there = _at(spark, path)
    files.deleteOnExit(there)
    with _setting(spark, CLEANS, "true"):
        df.write.parquet(path)
    if (owner := _OWNER.get()) and not keep:
        _MADE.setdefault(owner, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing will read again."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            files, there = _at(t.sparkSession, path)
            files.delete(there, True)


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """``value`` sent to all executors, until its owner begins anew."""
    out = spark.sparkContext.broadcast(value)
    if owner := _OWNER.get():
        _MADE.setdefault(owner, []).append(out)
    return out


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is none of ``gone``'s.

    These ids are stored first, so their number is known: few go around, and texts stay where they are.
    """
    ids = table(gone.select(F.col("doc_id").alias("__gone")).distinct(), "gone-ids")
    sent = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(sent, docs["doc_id"].eqNullSafe(ids["__gone"]), "left_anti")


def among(keys: DataFrame, key: Column) -> Column:
    """A condition on ``key`` (long): true for all of ``keys`` (one column of longs, without nulls) and for few others.

    Rows that can't meet ``keys`` so go before they are shuffled. It is a Bloom filter of two bits for each key, of a
    bounded size, which all tasks get as a constant: the more keys there are beyond that, the more others pass.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    pieces = max(1, min(PIECES, -(-keys.count() * FILTER_BITS // PIECE)))
    spots = lambda x: [F.pmod(x, F.lit(pieces * PIECE)), F.pmod(F.xxhash64(x), F.lit(pieces * PIECE))]
    at = keys.select(F.explode(F.array(*spots(F.col(name)))).alias("at"))
    built = at.groupBy(F.floor(F.col("at") / PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE).alias("bits"))
    whole = bytearray(pieces * PIECE // 8)
    for r in built.toLocalIterator():
        whole[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = r["bits"]
    constant = table(spark.createDataFrame([(whole,)], "bits binary"), "filter").scalar()
    byte = lambda spot: F.conv(F.hex(F.substring(constant, F.shiftright(spot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda spot: F.call_function("shiftright", byte(spot), (spot % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    first, second = map(is_set, spots(key))
    return first & second


@contextlib.contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables and broadcasts made meanwhile are the owner's; those that it made before go.

    Only for callers whose former results are already written elsewhere.
    """
    release(spark, owner)
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def release(spark: SparkSession, owner: str) -> None:
    """Delete what the owner has made."""
    for made in _MADE.pop(owner, []):
        if isinstance(made, Broadcast):
            made.destroy()
        else:
            files, there = _at(spark, made)
            files.delete(there, True)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python workers are given ``rows`` rows at a time; for tables with several long texts in a row."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)
