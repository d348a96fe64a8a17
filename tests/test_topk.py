"""The k best by block bounds against the full ranking."""

import random

import pytest
from pyspark.sql import functions as F

from callweave import schema
from callweave.operators import search, topk


@pytest.fixture(scope="module")
def index(spark):
    """Words of very different frequency, in texts of 1 to 30 words; many scores tie."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(30)]
    text = lambda: " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randrange(1, 9)))
    rows = [(f"s{k:05d}", text(), "function", None if k % 5 else text(), "f.rs", 1, 1, 0, 0, text() if k % 3 else "", None, False) for k in range(3000)]
    nodes = spark.createDataFrame(rows, schema.NODES).cache()
    post = search.index_rows(nodes).cache()
    return nodes, post


QUERIES = ["w0", "w29", "w0 w1", "w2 AND w9", "w5 OR w20", "w1 OR w2 OR w3", "w7 w7", "none", "w0 none", "w28 w29"]


@pytest.mark.parametrize(("block", "shard", "queries", "other"), [(16, 1_000_000, QUERIES, 1), (8, 300, ["w1", "w0 w3", "w4 OR none"], 1), (16, 1_000_000, ["w9", "w2 w4"], 1.1)])
def test_same_as_the_full_ranking(spark, index, block, shard, queries, other):
    """``other``: whether the blocks are of an index of another mean length."""
    nodes, post = index
    mean = topk.mean_length(post, nodes.count())
    rows = topk.entries(post, mean, shard, block).cache()
    heads = topk.blocks(rows, mean * other).cache()
    best = topk.Best(spark, rows, heads, nodes.count())
    fewer = 0
    for query in queries:
        for k in (1, 30) if query in ("w0", "w2 AND w9") else (30,):
            got = [tuple(r) for r in best(query, k).collect()]
            want = search.match(nodes, query, post).select("id", F.round("rank", 9).alias("rank")).orderBy("rank", "id").limit(k)
            assert got == [tuple(r) for r in want.collect()], query
            assert best.read <= best.there
            fewer += best.read < best.there / 2
    assert fewer or queries is not QUERIES
    for query in ("w0*", '"w0 w1"', "w0 NOT w1", "name : w0", "^w0", "w0 OR w1 w2", "NEAR(w0 w1)"):
        assert best(query) is None
    with pytest.raises(search.QuerySyntaxError):
        best("a.b")


def test_shards_bound_the_rows_put_in_order(index):
    _, post = index
    rows = topk.entries(post, 10.0, 300, 8)
    sizes = rows.groupBy("term", "shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("b"), F.max("block").alias("last")).collect()
    assert max(r["n"] for r in sizes) < 600 and all(r["b"] == r["last"] + 1 == -(-r["n"] // 8) for r in sizes)
    assert rows.groupBy("term", "id").count().where("count > 1").isEmpty()
