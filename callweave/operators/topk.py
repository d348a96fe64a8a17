"""The k best symbols for a query of words, by BM25, without reading all that match.

A word's symbols are stored in the order of falling impact, what a symbol's count of the word and its length make of the
score, and in blocks, of which the largest impact is known. A query reads the first blocks of its words, and then twice
as many, until no symbol that it hasn't met, and none that it has met for some of the words alone, can still come before
the kth best: what they may get from unread blocks is bounded by these, and as equal impacts lie in the order of ids, so
is the id of one that ties. The scores are those of the full ranking.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.operators import search
from callweave.operators.search import K1, B, Phrase

#: Symbols of a block.
BLOCK = 128
#: A word's symbols are put in order in shards of about so many, so that no task orders all symbols of a frequent word.
SHARD_ROWS = 500_000
#: Decimals of a score; what is equal in them is a tie.
DECIMALS = 9
#: More than rounding can make of a difference.
CLOSE = 2e-9


def _impact(tf: Column, tokens: Column, mean: float | Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * tokens / mean))


def mean_length(postings: DataFrame, docs: int) -> float:
    """Words of a symbol; there is a row for each."""
    return postings.count() / max(docs, 1) or 1.0


def entries(postings: DataFrame, mean: float, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """term, block, shard, id, tf, tokens, of ``search.index_rows``, in the order of their impact at ``mean``."""
    each = postings.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("tokens").alias("tokens"))
    sizes = each.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    each = each.join(sizes, "term").withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int"))
    falling = Window.partitionBy("term", "shard").orderBy(F.desc(_impact(F.col("tf"), F.col("tokens"), F.lit(mean))), "id")
    return each.select("term", F.floor((F.row_number().over(falling) - 1) / block).cast("int").alias("block"), "shard", "id", F.col("tf").cast("int").alias("tf"), "tokens")


def blocks(rows: DataFrame, mean: float) -> DataFrame:
    """term, block, shard, symbols, words (how often the term stands in them), and bounds.

    most is the largest impact at ``mean``; most_tf and least_tokens bound it at any other, once symbols have come or gone.
    """
    most = F.max(_impact(F.col("tf"), F.col("tokens"), F.lit(mean))).alias("most")
    own = rows.groupBy("term", "block", "shard").agg(F.count(F.lit(1)).alias("symbols"), F.sum("tf").alias("words"), F.max("tf").alias("most_tf"), F.min("tokens").alias("least_tokens"), F.min("id").alias("least_id"), most)
    return own.withColumn("mean", F.lit(mean))


def plain_words(query: str) -> tuple[list[str], bool] | None:
    """The words of a query in which all (True) or any (False) of them must stand; None for other queries."""
    tree = search.parse(query)
    kinds: set[str] = set()

    def walk(t) -> list[str] | None:
        if isinstance(t, Phrase):
            return list(t.words) if len(t.words) == 1 and not t.prefix and not t.first and t.columns is None else None
        if t[0] not in ("and", "or"):
            return None
        kinds.add(t[0])
        left, right = walk(t[1]), walk(t[2])
        return None if left is None or right is None else left + right

    words = walk(tree)
    return None if words is None or len(kinds) > 1 else (words, kinds != {"or"})


class Best:
    """A search over stored ``entries`` and ``blocks`` of ``docs`` symbols. After a call, ``read`` and ``there`` count blocks."""

    def __init__(self, spark: SparkSession, rows: DataFrame, heads: DataFrame, docs: int):
        self.spark, self.rows, self.heads, self.docs = spark, rows, heads, docs
        self.read = self.there = 0

    def __call__(self, query: str, k: int = 30) -> DataFrame | None:
        """id and rank, the less the better, of the k best, ties by id; None if the query isn't of words alone."""
        if (asked := plain_words(query)) is None:
            return None
        times, every = Counter(asked[0]), asked[1]
        words = sorted(times)
        own = self.heads.where(F.col("term").isin(words))
        facts = {r["term"]: r for r in own.groupBy("term").agg(F.sum("symbols").alias("df"), F.max("block").alias("last"), F.count(F.lit(1)).alias("blocks")).collect()}
        self.there, self.read = sum(r["blocks"] for r in facts.values()), 0
        if not facts or every and len(facts) < len(words):
            return self.spark.createDataFrame([], "id string, rank double")
        words = [w for w in words if w in facts]
        mean = self.heads.agg(F.sum("words")).first()[0] / self.docs
        weight = {w: times[w] * max(math.log((self.docs - facts[w]["df"] + 0.5) / (facts[w]["df"] + 0.5)), 1e-6) for w in words}
        depth = 1
        while True:
            found, done = self._round(words, weight, mean, depth, every, k)
            if done or depth > max(r["last"] for r in facts.values()):
                break
            depth *= 2
        self.read = own.where(F.col("block") < depth).count()
        return self._exact(found, words, weight, mean, depth, every, k)

    def _met(self, words: list[str], weight: dict[str, float], mean: float, depth: int) -> DataFrame:
        """Of the symbols of the first ``depth`` blocks: which words were met (a bit for each), and what they give."""
        place = F.create_map(*[x for n, w in enumerate(words) for x in (F.lit(w), F.lit(1 << n))])
        weights = F.create_map(*[x for w in words for x in (F.lit(w), F.lit(weight[w]))])
        rows = self.rows.where(F.col("term").isin(words) & (F.col("block") < depth))
        score = F.element_at(weights, F.col("term")) * _impact(F.col("tf"), F.col("tokens"), F.lit(mean))
        return rows.groupBy("id").agg(F.sum(F.element_at(place, F.col("term"))).alias("met"), F.sum(score).alias("score"))

    def _round(self, words: list[str], weight: dict[str, float], mean: float, depth: int, every: bool, k: int) -> tuple[list[str], bool]:
        """Ids of the best so far, and whether no other symbol can be among them."""
        met = self._met(words, weight, mean, depth)
        whole = (1 << len(words)) - 1
        top = met.where(F.col("met") == whole) if every else met
        best = top.orderBy(F.desc(F.round("score", DECIMALS)), "id").limit(k).collect()
        ids = [r["id"] for r in best]
        weights = F.create_map(*[x for w in words for x in (F.lit(w), F.lit(weight[w]))])
        bound = F.when(F.col("mean") == mean, F.col("most")).otherwise(_impact(F.col("most_tf"), F.col("least_tokens"), F.lit(mean)))
        bound = F.element_at(weights, F.col("term")) * bound
        heads = self.heads.where(F.col("term").isin(words) & (F.col("block") >= depth)).select("term", "least_id", bound.alias("bound"))
        first = F.min(F.struct((-F.round("bound", DECIMALS)).alias("falling"), "least_id"))["least_id"]
        unread = heads.groupBy("term").agg(F.max("bound").alias("most"), first.alias("id")).collect()
        if not unread:
            return ids, True
        if len(best) < k:
            return ids, False
        score, last = best[-1]["score"], ids[-1]
        # a symbol of unread blocks alone: beyond the kth best, or as good by all words, and then not before the first ids there
        most = sum(r["most"] for r in unread)
        if (not every or len(unread) == len(words)) and (most > score + CLOSE or most >= score - CLOSE and max(r["id"] for r in unread) <= last):
            return ids, False
        by = {r["term"]: r["most"] for r in unread}
        lacks = [F.col("met").bitwiseAND(1 << n) == 0 for n in range(len(words))]
        may = F.col("score") + sum((F.when(no, F.lit(by.get(w, 0.0))).otherwise(0.0) for no, w in zip(lacks, words, strict=True)), F.lit(0.0))
        others = met.where(~F.col("id").isin(ids) & ((may > score + CLOSE) | (may >= score - CLOSE) & (F.col("id") < last)))
        if every:  # one that lacks a word whose blocks have all been read can't have all of them
            for no, w in zip(lacks, words, strict=True):
                others = others if w in by else others.where(~no)
        return ids, others.isEmpty()

    def _exact(self, ids: list[str], words: list[str], weight: dict[str, float], mean: float, depth: int, every: bool, k: int) -> DataFrame:
        """The best with their whole scores. Where any word may stand, those of a symbol may be in unread blocks: it is looked up by id."""
        rows = self.rows.where(F.col("term").isin(words) & F.col("id").isin(ids))
        if every or len(words) == 1:
            rows = rows.where(F.col("block") < depth)
        weights = F.create_map(*[x for w in words for x in (F.lit(w), F.lit(weight[w]))])
        score = F.element_at(weights, F.col("term")) * _impact(F.col("tf"), F.col("tokens"), F.lit(mean))
        return rows.groupBy("id").agg(F.round(-F.sum(score), DECIMALS).alias("rank")).orderBy("rank", "id").limit(k)
