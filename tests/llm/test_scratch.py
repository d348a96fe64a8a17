import time

from pyspark.sql import functions as F

from callweave.llm import scratch


def test_among(spark, monkeypatch):
    hashed = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    wanted = hashed.where("id % 7 = 0").select("h")
    for pieces in (scratch.PIECES, 1):
        monkeypatch.setattr(scratch, "PIECES", pieces)
        passed = {r["id"] for r in hashed.where(scratch.among(wanted, F.col("h"))).collect()}
        assert passed >= set(range(0, 20_000, 7)) and len(passed) < (3_500 if pieces > 1 else 9_000)
    assert hashed.where(scratch.among(wanted.limit(0), F.col("h"))).count() == 0


def test_what_a_table_shuffled_goes(spark):
    files = lambda: sum("shuffle_" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    out = scratch.table(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).count(), "test")
    assert out.count() == 100
    began = time.time()
    while (now := files()) > before and time.time() - began < 20:
        time.sleep(0.1)
    assert now <= before
    assert spark.conf.get(scratch.CLEANS) == "false"
