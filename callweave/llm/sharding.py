"""Sharding by fixed virtual slots: records are hashed into thousands of slots, and a versioned map says which shard has a slot.

The map begins with equal ranges of slots, and is edited by the bytes that the slots hold: as few slots as are needed go
from full shards to others. An edit is a new version, stored beside the ones before, so a reader of any version finds a
record by its key and the map alone, and a change of the number of shards moves only the slots that the edit names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm import scratch

#: Virtual slots; they stay as they are while shards come and go.
SLOTS = 4096
#: Shards may differ from the mean by such a share before the map is edited, and are brought as near as slots allow.
TOLERANCE = 0.0005
#: Rows that are numbered in one group, about.
GROUP_ROWS = 50_000


@dataclass(frozen=True)
class SlotMap:
    """owners: the shard of each slot."""

    version: int
    shards: int
    owners: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        """Equal ranges of slots."""
        return SlotMap(1, shards, tuple(s * shards // slots for s in range(slots)))

    def loads(self, weights: Sequence[int]) -> list[int]:
        out = [0] * self.shards
        for owner, w in zip(self.owners, weights, strict=True):
            out[owner] += w
        return out

    def moved(self, after: SlotMap) -> list[int]:
        """Slots whose shard is another one in ``after``."""
        return [s for s, (a, b) in enumerate(zip(self.owners, after.owners, strict=True)) if a != b]

    def rebalanced(self, weights: Sequence[int], tolerance: float = TOLERANCE) -> SlotMap:
        """The next version: slots go, or change places, between the fullest shard and an emptier one until none helps.

        Each step takes what comes nearest to half of the difference, so shards differ by less than the slots they
        hold allow. The same map if shards are within the tolerance already, or nothing can be mended.
        """
        owners, loads = np.array(self.owners), self.loads(weights)
        weight = np.array(weights, dtype=np.int64)
        bound = tolerance * sum(loads) / max(self.shards, 1)
        while self.shards > 1 and (high := int(np.argmax(loads))) >= 0 and loads[high] - min(loads) > bound:
            for low in sorted(range(self.shards), key=lambda s: loads[s]):
                step = _step(weight, owners, high, low, loads[high] - loads[low])
                if step is not None:
                    break
            else:
                break
            give, take, amount = step
            owners[give] = low
            if take is not None:
                owners[take] = high
            loads[high] -= amount
            loads[low] += amount
        after = tuple(int(x) for x in owners)
        return self if after == self.owners else replace(self, version=self.version + 1, owners=after)

    def grown(self, weights: Sequence[int]) -> SlotMap:
        """The next version with one more shard, which alone takes slots: from the fullest, up to its equal share."""
        owners, loads = list(self.owners), [*self.loads(weights), 0]
        share = sum(loads) / (self.shards + 1)
        by_shard: dict[int, list[int]] = {}
        for s in sorted(range(len(owners)), key=lambda s: weights[s]):
            by_shard.setdefault(owners[s], []).append(s)
        while True:
            givers = sorted((s for s in range(self.shards) if by_shard.get(s)), key=lambda s: -loads[s])
            fits = ((d, s) for d in givers for s in reversed(by_shard[d]) if loads[-1] + weights[s] <= share and 0 < weights[s] <= loads[d] - share)
            found = next(fits, None)
            if found is None:
                break
            giver, slot = found
            by_shard[giver].remove(slot)
            owners[slot] = self.shards
            loads[giver] -= weights[slot]
            loads[-1] += weights[slot]
        return SlotMap(self.version + 1, self.shards + 1, tuple(owners))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, x) for s, x in enumerate(self.owners)], "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """A folder for each version; it is an error if there is one already, so of two editors one fails."""
        self.table(spark).drop("version").coalesce(1).write.mode("error").parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A version, or the last one."""
        rows = spark.read.parquet(folder)
        version = version or rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == version).orderBy("virtual_slot").collect()  # as many as there are slots
        return SlotMap(int(version), found[0]["shards"], tuple(r["shard"] for r in found))


def _step(weight: np.ndarray, owners: np.ndarray, high: int, low: int, gap: int) -> tuple[int, int | None, int] | None:
    """A slot of ``high``, one of ``low`` or none, and by how much their change of places lowers the one and lifts the other."""
    own, other = (np.flatnonzero((owners == s) & (weight > 0)) for s in (high, low))
    if not len(own) or gap < 2:
        return None
    base = np.concatenate([[0], np.sort(weight[other])])
    slots = np.concatenate([[-1], other[np.argsort(weight[other], kind="stable")]])
    best: tuple[int, int, int | None, int] | None = None
    mine = weight[own]
    at = np.searchsorted(base, mine - gap // 2)
    for shift in (-1, 0):
        j = np.clip(at + shift, 0, len(base) - 1)
        amount = mine - base[j]
        off = np.where((amount > 0) & (amount < gap), np.abs(2 * amount - gap), np.iinfo(np.int64).max)
        k = int(off.argmin())
        if off[k] < gap and (best is None or off[k] < best[0]):
            best = (int(off[k]), int(own[k]), int(slots[j[k]]) if slots[j[k]] >= 0 else None, int(amount[k]))
    return None if best is None else best[1:]


def virtual_slot(doc_id: Column, instead: Column, slots: int = SLOTS) -> Column:
    """The slot of a record by its key; records without a key go by ``instead``."""
    return F.pmod(F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(instead)), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, salt of each row; the texts are read for this, and never move."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slot = virtual_slot(F.col("doc_id"), F.struct("text_crc32", "size"), slots)
    return rows.withColumns({"virtual_slot": slot, "salt": F.monotonically_increasing_id()})


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], int]:
    """Bytes of each virtual slot, and the number of rows; the driver gets a row for each slot at most."""
    out, n = [0] * slots, 0
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        out[r["virtual_slot"]] = r["size"]
        n += r["n"]
    return out, n


def numbered(rows: DataFrame, n: int, slots: int = SLOTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` (virtual_slot, shard, salt) with slot: their places within their shard, from 0 and without gaps.

    A virtual slot's rows are numbered in groups of about ``group_rows`` rows, dealt by their salt, so that no task
    gets a whole shard and rows that repeat a key don't meet in one; a group's first number is what the groups before
    it in the shard hold.
    """
    groups = max(1, -(-n // (slots * group_rows)))
    rows = rows.withColumn("__group", F.pmod("salt", F.lit(groups)).cast("int"))
    own = Window.partitionBy("virtual_slot", "__group").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "salt")
    placed = rows.withColumn("__at", F.row_number().over(own).cast("long") - 1)
    counts = rows.groupBy("virtual_slot", "__group", "shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(starts, ["virtual_slot", "__group"]).withColumn("slot", F.col("__start") + F.col("__at")).drop("__start", "__at", "__group")


def place(docs: DataFrame, shards: int = 8, slots: int = SLOTS, folder: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot and map_version of every row.

    The law is ``bytes``: the shards' sizes are near equal, as near as the slots' bytes allow. A row's size is the bytes
    of its text and one, so null and empty texts have the size 1 and the checksum 0. Rows that repeat a doc_id are in
    the same slot, and so in the same shard; rows without one go by their text. A shard may stay empty if there are
    fewer slots with rows than shards; an empty table gives an empty result. Columns other than doc_id and text are
    ignored.

    ``folder``: where the map's versions are stored. If it has some, the last one is edited; otherwise the first begins
    there, or in the shared folder.
    """
    spark = docs.sparkSession
    rows = scratch.table(records(docs, slots), "records")
    weights, n = slot_weights(rows, slots)
    folder = folder or scratch.path(spark, "slot-map")
    if scratch.exists(spark, folder):
        now = SlotMap.load(spark, folder)
        if (now.shards, len(now.owners)) != (shards, slots):
            raise ValueError(f"the map in {folder} has {now.shards} shards and {len(now.owners)} slots")
    else:
        now = SlotMap.first(shards, slots)
        now.save(spark, folder)
    after = now.rebalanced(weights, tolerance)
    if after.version != now.version:
        after.save(spark, folder)
    owners = spark.read.schema("shards int, virtual_slot int, shard int").parquet(f"{folder}/version={after.version}")
    # a row for each slot
    rows = rows.join(F.broadcast(owners.select("virtual_slot", "shard")), "virtual_slot")
    return numbered(rows, n, slots).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot", F.lit(after.version).alias("map_version"))
