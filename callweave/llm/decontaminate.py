"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle sets. For each partition, a document is a row of windows, each of
two blocks as long as the partition's largest item, so the sets compared are of like size and their Jaccard similarity
has a lower bound that follows from the containment sought. The number of MinHash functions follows from that bound.
An agreeing minimum makes a candidate; its containment in the whole document is then counted. Items whose shingles are
scattered over the document agree in no window; they are found by counting, for each document that has any shingle of an
item, how many it has of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import memory, scratch, shingles

#: Items whose signatures are sent around at once; more are searched for in further passes.
BLOCK = 20_000
#: Chance that an item just at the threshold, within a window, agrees in no minimum.
MISS = 1e-7


@dataclass(frozen=True)
class Partition:
    size: int  # shingles of its largest item
    numbers: np.ndarray  # of its items
    factors: np.ndarray  # one odd number for each MinHash function
    minima: np.ndarray  # (functions, items): the shingles that are an item's minima


@dataclass(frozen=True)
class Index:
    sets: list[np.ndarray]
    partitions: list[Partition]
    shingles: np.ndarray  # of all items, distinct and sorted
    minimum: np.ndarray  # whether such a shingle is a minimum of some item
    first: np.ndarray  # place in ``holders`` where the items that hold such a shingle begin, and the end
    holders: np.ndarray
    least: np.ndarray  # shingles of each item that make it contained, at least one
    sieve: np.ndarray  # the shingles' leading bits
    shift: np.uint64


def _sieve(tokens: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    bits = min(26, max(20, (8 * len(tokens)).bit_length()))
    out, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
    out[(tokens >> shift).astype(np.int64)] = True
    return out, shift


def functions_for(size: int, containment: float, miss: float) -> int:
    """MinHash functions so that items of (size / 2, size] shingles are missed with at most that chance."""
    least = size // 2 + 1
    shared = math.ceil(containment * least)
    jaccard = shared / (least + 2 * size - shared)
    return max(8, math.ceil(math.log(miss) / math.log(1 - jaccard)))


def build_index(texts: list[str | None], containment: float, miss: float = MISS) -> Index:
    found = list(shingles.sets(texts))
    by_size: dict[int, list[int]] = {}
    for k, s in enumerate(found):
        if len(s):
            by_size.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
    parts = []
    for size, numbers in sorted(by_size.items()):
        n = functions_for(size, containment, miss)
        factors = np.random.default_rng(size).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        minima = np.stack([[s[(s * f).argmin()] for s in (found[k] for k in numbers)] for f in factors])
        parts.append(Partition(size, np.array(numbers), factors, minima))
    everything = np.concatenate([np.empty(0, np.uint64), *found])
    holder = np.repeat(np.arange(len(found)), [len(x) for x in found])
    order = np.argsort(everything, kind="stable")
    tokens, first = np.unique(everything[order], return_index=True)
    minima = np.unique(np.concatenate([p.minima.ravel() for p in parts])) if parts else np.empty(0, np.uint64)
    least = np.array([max(1, math.ceil(containment * len(x))) for x in found], np.int64)
    return Index(found, parts, tokens, np.isin(tokens, minima), np.append(first, len(everything)), holder[order], least, *_sieve(tokens))


def candidates(h: np.ndarray, at: np.ndarray, p: Partition) -> set[int]:
    """Items that share a minimum with a window of the document's shingles ``h``.

    ``at`` are the places of shingles that are some item's minimum: windows without one agree with no item, so their
    minima aren't computed.
    """
    out: set[int] = set()
    last = max(0, (len(h) - 1) // p.size - 1)
    block = at // p.size
    for w in np.unique(np.clip(np.concatenate([block - 1, block]), 0, last)):
        window = h[w * p.size : (w + 2) * p.size]
        for f, minima in zip(p.factors, p.minima, strict=True):
            agree = minima == window[(window * f).argmin()]
            if agree.any():
                out.update(p.numbers[agree].tolist())
    return out


def scattered(tokens: np.ndarray, index: Index) -> np.ndarray:
    """Items of which a document holds enough shingles anywhere; ``tokens``: numbers of the distinct shingles it holds."""
    size = index.first[tokens + 1] - index.first[tokens]
    at = np.repeat(index.first[tokens] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.flatnonzero(np.bincount(index.holders[at], minlength=len(index.least)) >= index.least)


def search(h: np.ndarray, index: Index, containment: float) -> list[tuple[int, int]]:
    """(item, shared shingles) of the items contained in a document with shingles ``h``."""
    if not len(index.shingles):
        return []
    at = np.flatnonzero(index.sieve[(h >> index.shift).astype(np.int64)])
    number = np.minimum(np.searchsorted(index.shingles, h[at]), len(index.shingles) - 1)
    there = index.shingles[number] == h[at]
    at, number = at[there], number[there]
    if not len(at):
        return []
    least = at[index.minimum[number]]
    found = set().union(*(candidates(h, least, p) for p in index.partitions)) if len(least) else set()
    own = np.unique(number)
    found.update(scattered(own, index).tolist())
    mine = index.shingles[own]
    out = []
    for k in sorted(found):
        q = index.sets[k]
        shared = int(np.isin(q, mine, assume_unique=True).sum())
        if shared >= containment * len(q):
            out.append((k, shared))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = 0.75, block: int = BLOCK) -> DataFrame:
    """One row for each document and benchmark item contained in it: doc_id, item_id, n_shared, n_item, containment.

    An item is contained if at least ``containment`` of its distinct shingles are in the document. An item of fewer than
    five words is contained in a document that is the same sequence of words; null or empty items and documents match
    nothing. Shingles may be scattered over the document, however long it is. Repeated rows on either side give repeated
    pairs; other columns are ignored; an empty table on either side gives an empty result. A long text is hashed in pieces;
    a task holds one document's shingles at a time.

    Documents aren't shuffled. Items go around in blocks of ``block``, a pass over the documents for each.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    # ids go through Python as strings: a column of longs with a null in it would become floats there
    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    own = items.select("item_id", items["text"].cast("string").alias("text"))
    n = own.count()
    parts = [own] if n <= block else [own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-n // block))) == k) for k in range(-(-n // block))]
    schema = "doc_id string, item long, n_shared long, n_item long, containment double"
    out = spark.createDataFrame([], f"doc_id {doc_kind}, item_id {item_kind}, n_shared long, n_item long, containment double")
    for part in parts:
        chosen = part.orderBy("item_id", "text").collect()
        sent = scratch.broadcast(spark, build_index([r["text"] for r in chosen], containment))
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(chosen)], f"item long, item_id {item_kind}")
        found = rows.mapInPandas(_searcher(sent, containment), schema).join(F.broadcast(names), "item")
        out = out.unionAll(found.select(F.col("doc_id").cast(doc_kind).alias("doc_id"), "item_id", "n_shared", "n_item", "containment"))
    return out


def _searcher(sent, containment: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory.begin("decontaminate")
        index = sent.value
        for b in batches:
            hits = []
            for doc_id, h in zip(b["doc_id"], shingles.ordered(list(b["text"])), strict=True):
                for k, shared in search(h, index, containment) if len(h) else ():
                    n = len(index.sets[k])
                    hits.append((doc_id, k, shared, n, shared / n))
            yield pd.DataFrame(hits, columns=["doc_id", "item", "n_shared", "n_item", "containment"])
        del index
        memory.give_back()

    return run


def clean(docs: DataFrame, items: DataFrame, containment: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns. A null doc_id is kept unless such a row contains one."""
    return scratch.without(docs, find_leaks(docs, items, containment))
