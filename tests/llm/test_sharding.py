"""Virtual slots: the law, the numbering, and the versions of the map."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callweave.llm import queries, scratch, sharding
from callweave.llm.sharding import SlotMap

SF = "/root/testdata/sf0.001"


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_against_the_texts(spark):
    rows = queries.op11_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode())) for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None} and {r["shard"] for r in rows} <= set(range(8))
    gapless(rows)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_sizes_are_near_equal(spark, sf):
    """Within a hundredth of the mean, beyond what a single record holds that is larger than a shard's share."""
    rows = queries.op11_sharding(spark, sf).groupBy("shard").agg(F.sum("size").alias("size"), F.max("size").alias("most")).collect()
    mean = sum(r["size"] for r in rows) / 8
    assert all(r["size"] <= max(1.01 * mean, r["most"]) for r in rows)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, names that clash."""
    data = [(1, "a"), (1, "a"), (1, "b"), (2, None), (3, ""), (None, "x"), (None, None), (4, "ü" * 50_000), (5, "😀")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"shard": F.lit("?"), "slot": F.lit(1), "size": F.lit(0), "salt": F.lit(2), "__n": F.lit(3)})
    rows = sharding.place(docs, shards=3).collect()
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    gapless(rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.place(docs.limit(0)).collect() == []


def test_numbers_have_no_gaps_in_many_groups(spark):
    """However many groups a virtual slot is dealt into, and one key with a third of all rows."""
    docs = spark.range(3000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = scratch.table(sharding.records(docs, 5).withColumn("shard", F.col("virtual_slot") % 2), "t")
    out = sharding.numbered(rows, 3000, 5, group_rows=50).collect()
    assert len(out) == 3000
    gapless(out)


def test_rebalancing_moves_little():
    rng = random.Random(1)
    weights = [rng.randrange(900, 1100) for _ in range(4096)]
    first = SlotMap.first(8)
    after = first.rebalanced(weights)
    assert after.version == 2 and len(first.moved(after)) < 400
    loads = after.loads(weights)
    assert max(loads) - min(loads) <= sharding.TOLERANCE * sum(weights) / 8
    assert after.rebalanced(weights) == after
    heavy = [w * (20 if s < 300 else 1) for s, w in enumerate(weights)]
    again = after.rebalanced(heavy)
    assert again.version == 3 and max(again.loads(heavy)) - min(again.loads(heavy)) <= sharding.TOLERANCE * sum(heavy) / 8


def test_growth_moves_into_the_new_shard_alone():
    rng = random.Random(2)
    weights = [rng.randrange(1000) for _ in range(4096)]
    before = SlotMap.first(8).rebalanced(weights)
    after = before.grown(weights)
    assert {after.owners[s] for s in before.moved(after)} == {8} and after.shards == 9
    loads = after.loads(weights)
    assert max(loads) < 1.02 * sum(loads) / 9 and min(loads) > 0.98 * sum(loads) / 9


@pytest.mark.parametrize("weights", [[0] * 16, [5] + [0] * 15, [1] * 16, [100, 1, 1, 1] * 4, list(range(16))])
def test_small_maps_end(weights):
    after = SlotMap.first(4, 16).rebalanced(weights, 0)
    assert sum(after.loads(weights)) == sum(weights)
    assert SlotMap.first(1, 16).rebalanced(weights, 0).version == 1
    assert set(after.grown(weights).owners) <= set(range(5))


def test_versions_are_stored(spark):
    """A later run edits the last version; older ones stay readable, and none is written twice."""
    folder = scratch.path(spark, "versions")
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one = sharding.place(docs, 4, folder=folder).select("doc_id", "shard", "map_version").collect()
    version = one[0]["map_version"]
    large = docs.withColumn("text", F.when(F.col("doc_id") < 40, F.repeat(F.lit("y"), 1000)).otherwise("x"))
    two = sharding.place(large, 4, folder=folder).select("doc_id", "shard", "map_version").collect()
    last = SlotMap.load(spark, folder)
    assert two[0]["map_version"] == last.version > version
    first = SlotMap.load(spark, folder, version)
    old, new = ({r["doc_id"]: r["shard"] for r in x} for x in (one, two))
    assert {i for i in old if old[i] != new[i]} and len(first.moved(last)) < 100
    assert SlotMap.load(spark, folder, 1) == SlotMap.first(4)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        last.save(spark, folder)
    with pytest.raises(ValueError, match="4 shards"):
        sharding.place(docs, 5, folder=folder)
