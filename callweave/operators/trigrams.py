"""Substring lookup by trigrams: an index of the three-letter pieces of symbols' texts.

A text that contains a pattern has all trigrams of the pattern's literal runs. The index tells how many symbols have
each of them, so only the rarest are intersected, and the symbols that are left are compared with the whole pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.columns import fold, folded
from callweave.operators.lookup import find_like

SIZE = 3
#: So many of a pattern's trigrams are intersected; the others would hardly leave fewer symbols.
RAREST = 3
#: Ids of candidates that go into the filter of the scan; beyond it they are joined.
IDS = 1_000
TEXTS = ["name", "qualified_name", "id"]


def index_rows(nodes: DataFrame) -> DataFrame:
    """gram, id: each trigram of each symbol's texts once."""
    text = folded(F.concat_ws("\0\0", *TEXTS))  # no trigram of letters goes over two texts
    starts = F.sequence(F.lit(1), F.greatest(F.length("text") - SIZE + 1, F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda k: F.substring(F.col("text"), k, F.lit(SIZE))))
    each = nodes.select("id", text.alias("text")).select(F.explode(grams).alias("gram"), "id")
    return each.where((F.length("gram") == SIZE) & ~F.contains("gram", F.lit("\0")))


def literal_grams(query: str) -> list[str]:
    """The trigrams that every text has that matches, in any order; none if all literal runs are shorter."""
    runs = re.split("[%_]", fold(query))
    return sorted({run[k : k + SIZE] for run in runs for k in range(len(run) - SIZE + 1)})


def find_like_indexed(nodes: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """The same as ``lookup.find_like``; ``index``: stored ``index_rows`` of the same symbols, in the order of gram.

    A pattern without a literal run of three letters is looked for in all symbols. How many symbols the pattern's
    trigrams have is counted at once: of each only the first column is read, of the row groups that hold it.
    """
    wanted = literal_grams(query)
    if not wanted:
        return find_like(nodes, query)
    counts = {r["gram"]: r["n"] for r in index.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < len(wanted):
        return nodes.limit(0)
    rarest = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
    held = index.where(F.col("gram").isin(rarest)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("id")
    if counts[rarest[0]] <= IDS:
        nodes = nodes.where(F.col("id").isin([r["id"] for r in held.collect()]))
    else:
        nodes = nodes.join(held, "id", "left_semi")
    return find_like(nodes, query)
