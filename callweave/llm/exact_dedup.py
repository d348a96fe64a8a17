"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm import scratch

#: Code points hashed by the second step.
PREFIX = 256
#: Keys of surviving groups (16 bytes each) that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Parts in which the rows of each group are joined back to the group's summary.
SALTS = 16


def full_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def surviving_keys(rows: DataFrame) -> DataFrame:
    """(len, prefix) of groups of two rows or more; a group that is single by length is never hashed.

    Both counts are combined before they are shuffled, so a group that holds most rows costs a row per task.
    """
    by_length = rows.groupBy("__len", "__head").agg(F.count(F.lit(1)).alias("__n"))
    # a length with one (length, prefix) group of one row is the first step's singleton
    return by_length.where("__n > 1").select("__len", "__head")


def exact_groups(docs: DataFrame, prefix: int = PREFIX, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(sha, keep_id, group_size) of each text that two rows or more have.

    Step 1 counts lengths from the column's byte length; step 2 hashes ``prefix`` code points of rows whose
    length another row shares; step 3 reads whole texts, only of rows whose length and prefix another row shares.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("__id"), text.alias("__text"), F.octet_length(text).alias("__len"))
    lengths = base.groupBy("__len").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__len")
    lengths = scratch.table(lengths, "exact-lengths")
    step2 = _keep(base, lengths, ["__len"], broadcast_keys)
    head = F.xxhash64(F.substring("__text", 1, prefix))
    keys = scratch.table(surviving_keys(step2.select("__len", head.alias("__head"))), "exact-prefixes")
    step3 = _keep(base.withColumn("__head", head), keys, ["__len", "__head"], broadcast_keys)
    hashed = step3.select("__id", full_hash(F.col("__text")).alias("sha"))
    return hashed.groupBy("sha").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def _keep(rows: DataFrame, keys: DataFrame, on: list[str], broadcast_keys: int) -> DataFrame:
    """Rows whose key is in ``keys``; texts stay where they were read while the keys are few enough to send around."""
    if keys.count() <= broadcast_keys:
        return rows.join(F.broadcast(keys), on, "left_semi")
    return rows.join(keys, on, "left_semi")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, broadcast_keys: int = BROADCAST_KEYS, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as the empty text, and all empty texts are one group. Of equal texts the largest doc_id
    stays; rows that repeat both the text and that doc_id are all marked kept, as they are the same document. A null
    doc_id is smaller than any other; if a group has no other, it keeps null. Texts are equal only when identical:
    case and white space count. An empty table gives an empty result; other columns are ignored.
    """
    groups = exact_groups(docs, prefix, broadcast_keys)
    groups = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), full_hash(text).alias("sha"))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    out = rows.join(groups, ["sha", "__part"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
