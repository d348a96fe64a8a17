"""Near-duplicate documents: an n-gram Jaccard join filtered under several global token orders.

Two sets with Jaccard similarity t or more share a token among the first n - ceil(t * n) + 1 of each, under any global
order of the tokens. Candidates are found under the first order, in which frequent shingles come last, so that a passage
which many documents share brings none of them together. Each document keeps its prefixes under the further orders, and
a candidate must share a token under every one of them, and be allowed by sketches that bound how much the sets differ,
before texts are moved and the sets themselves are intersected.

Groups are as large as they like: a token that many documents share first brings each of them together with one of
them; once the verified links have been followed, only those of the token's documents that are not yet connected are
compared with one another. So no pair of different texts is left out, and no group is expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm import memory, scratch, shingles
from callweave.llm.components import components

#: Shingles whose frequency the first order knows; all others come before them. The order decides about speed alone.
FREQUENT = 1 << 17
#: Shingles counted at a time, times within these, and documents in all from which one is frequent.
COUNTED, LOCALLY, LEAST = 2_000_000, 3, 12
#: Documents of a token that are all compared at once; more are compared with the first, and the rest later.
SMALL = 8
#: Longs of a parity sketch, and of the larger one that sets of more shingles have bits have besides.
SKETCH = 16
#: Pairs of texts that a worker is given at once.
BATCH = 256
#: Orders in all.
ORDERS = 3
#: Pairs of ids (16 bytes) that are broadcast at most, to meet the rows that they name where these were read.
BROADCAST_PAIRS = 2_000_000


def needed(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar set has at least."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1 if n else 0


# -- the first order


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of shingles that several documents of a stretch of rows have."""

    def flush() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= LOCALLY
        return pa.record_batch([pa.array(tokens[many].view(np.int64)), pa.array(n[many])], ["token", "n"])

    memory.begin("jaccard_join")
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        for s in shingles.sets(b.column(0).to_pylist()):
            held.append(s)
            size += len(s)
            if size > COUNTED:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def frequent_tokens(docs: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` most frequent shingles, sorted, and the binary logarithm of their counts.

    All rows are counted; a shingle too rare to be met LOCALLY times in any stretch stays uncounted, and is then sorted
    as a rare one, which is as good an order as any.
    """
    counted = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_count_frequent, "token long, n long")
    found = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").limit(limit).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(found["n"].to_numpy(float)[order] + 1).astype(np.uint64)


def first_order(s: np.ndarray, tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sort keys: the class of frequency, then the hash."""
    key = s >> np.uint64(6)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        key = np.where(tokens[at] == s, key | (classes[at] << np.uint64(58)), key)
    return key


def in_prefix(s: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` tokens of a set in the order of ``key``."""
    if size < len(s):
        at = np.argpartition(key, size - 1)[:size]
        return s[at[np.argsort(key[at])]]
    return s[np.argsort(key)]


def further_prefix(s: np.ndarray, k: int, percent: int) -> np.ndarray:
    """The prefix under order ``k``, a random one: the leading half of each place in it, so that equal tokens stay equal."""
    places = shingles.mix(s ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64))
    size = prefix_size(len(s), percent)
    if size < len(s):
        places = np.partition(places, size - 1)[:size]
    return (places >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each residue of the hashes: whether an odd number of the set's shingles has it.

    Two sets differ in at least as many shingles as their sketches in bits. There are at least as many bits as shingles, so
    that sets which share little differ in nearly half of their bits, and those that are similar in two sevenths at most.
    """
    bits = max(64 * SKETCH, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _lists(rows: list[np.ndarray | None], kind: type = np.int64) -> pa.Array:
    ends = np.cumsum([0] + [0 if r is None else len(r) for r in rows], dtype=np.int32)
    found = [r for r in rows if r is not None]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, kind)))


def _summarise(frequent, percent: int):
    """doc_id, n, same (an earlier row's doc_id with the same set), prefixes and sketches, empty where there is such a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.begin("jaccard_join")
        tokens, classes = frequent.value
        seen: dict[bytes, object] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                ids = b.column(0).slice(at, 1024).to_pylist()
                sizes, same, prefixes, small, large = [], [], [], [], []
                further: list[list] = [[] for _ in range(1, ORDERS)]
                for doc_id, s in zip(ids, shingles.sets(b.column(1).slice(at, 1024).to_pylist()), strict=True):
                    sizes.append(len(s))
                    mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and doc_id is not None else None
                    earlier = seen.setdefault(mark, doc_id) if mark else None
                    same.append(earlier if earlier != doc_id else None)
                    own = mark and earlier == doc_id
                    prefixes.append(in_prefix(s, first_order(s, tokens, classes), prefix_size(len(s), percent)).view(np.int64) if own else None)
                    for k, held in enumerate(further, 1):
                        held.append(further_prefix(s, k, percent) if own else None)
                    sketch = parity(s) if own else None
                    small.append(None if sketch is None else np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH)))
                    large.append(None if sketch is None or len(sketch) == SKETCH else sketch)
                columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(same, pa.int64()), _lists(prefixes), _lists(small), _lists(large)]
                yield pa.record_batch(columns + [_lists(held, np.int32) for held in further], SUMMARY_NAMES)
        seen.clear()
        memory.give_back()

    return run


FURTHER = [f"order{k}" for k in range(1, ORDERS)]
SUMMARY_NAMES = ["doc_id", "n", "same", "prefix", "small", "large", *FURTHER]
SUMMARY = "doc_id long, n int, same long, prefix array<long>, small array<long>, large array<long>" + "".join(f", {c} array<int>" for c in FURTHER)


def small_allow(a: str, b: str, percent: int) -> Column:
    """Whether two sets may be similar as far as their sizes and small sketches tell; columns n, small with suffixes."""
    bits = sum((F.bit_count(F.get(f"small_{a}", F.lit(k)).bitwiseXOR(F.get(f"small_{b}", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    sizes = 100 * F.least(f"n_{a}", f"n_{b}") >= percent * F.greatest(f"n_{a}", f"n_{b}")
    return sizes & ((100 + percent) * bits <= (100 - percent) * (F.col(f"n_{a}") + F.col(f"n_{b}")))


def large_allow(a: str, b: str, percent: int) -> Column:
    """The same of the large sketches; true where a set has none."""
    # of a larger sketch the halves are laid over each other
    laid = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    both = F.zip_with(laid(f"large_{a}", f"large_{b}"), laid(f"large_{b}", f"large_{a}"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(both, F.lit(0), lambda acc, x: acc + x)
    fits = (100 + percent) * bits <= (100 - percent) * (F.col(f"n_{a}") + F.col(f"n_{b}"))
    return (F.size(f"large_{a}") == 0) | (F.size(f"large_{b}") == 0) | fits


def orders_allow(a: str, b: str) -> Column:
    """Whether two sets share a token of their prefixes under each further order."""
    both = [F.arrays_overlap(f"{c}_{a}", f"{c}_{b}") for c in FURTHER]
    return both[0] if len(both) == 1 else both[0] & both[1]


def _beside(pairs: DataFrame, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of ``rows`` (doc_id) for both sides, suffixed.

    Pairs go around if they are few, so that rows wait for the second side to be moved; a hot document is always an a.
    """
    few = pairs.count() <= BROADCAST_PAIRS
    sent = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    a, b = (rows.select(F.col("doc_id").alias(s), *[F.col(c).alias(f"{name}_{s}") for c, name in columns.items()]) for s in "ab")
    if few:
        a = a.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
    return b.join(sent(pairs), "b").join(a, "a")


def plausible(pairs: DataFrame, rows: DataFrame, percent: int, begin: int = 0) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches and further prefixes allow it.

    What is shorter is asked first, and only the pairs that it allows move what is longer: small sketches are of a fixed
    size, large ones of a bit or two for each shingle, prefixes of a byte for each shingle and order. ``begin``: steps
    that were taken before.
    """
    own = rows.where("same is null").withColumn("n", F.col("n").cast("long"))
    left = pairs
    steps = [(["n", "small"], small_allow("a", "b", percent)), (["n", "large"], large_allow("a", "b", percent)), (FURTHER, orders_allow("a", "b"))]
    for columns, allowed in steps[begin:]:
        after = scratch.table(_beside(left, own, {c: c for c in columns}).where(allowed).select("a", "b"), "pairs")
        if left is not pairs:
            scratch.drop(left)
        left = after
    return left


# -- candidates


def _pairs_of_tokens(percent: int):
    """Rows sorted by token and doc -> pairs (token null, a < b), and the rows of large tokens (b null).

    A pair whose tokens before this one are equal too has met at that one. ``n`` is negative in rows that bring no larger
    set to theirs. A token's rows may come in any number of batches: of those before only the first row is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: np.ndarray | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            if first is not None and first[0] == rows[0, 0]:
                rows = np.concatenate([first[:, None], rows], 1)
                resumed = True
            else:
                resumed = False
            token, doc, n, before = rows
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(starts, append=len(token))
            large = length > SMALL
            large[-1] = True
            if resumed:
                large[0] = True
            own = np.repeat(np.arange(len(starts)), length)
            left, right = [], []
            few = ~large[own]
            for d in range(1, SMALL):
                at = np.flatnonzero((own[d:] == own[:-d]) & few[d:]) if len(own) > d else np.empty(0, int)
                left.append(at)
                right.append(at + d)
            many = np.flatnonzero(large[own])
            left.append(starts[own[many]])
            right.append(many)
            x, y = np.concatenate(left), np.concatenate(right)
            fits = (doc[x] != doc[y]) & ((before[x] != before[y]) | (before[x] == 0)) & (np.where(np.abs(n[x]) <= np.abs(n[y]), n[x], n[y]) > 0)
            fits &= 100 * np.minimum(np.abs(n[x]), np.abs(n[y])) >= percent * np.maximum(np.abs(n[x]), np.abs(n[y]))
            x, y = x[fits], y[fits]
            pairs = np.unique(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])]), axis=1) if len(x) else np.empty((2, 0), np.int64)
            if resumed:  # that row has been passed on
                many = many[1:]
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.record_batch([none, pa.array(pairs[0]), pa.array(pairs[1]), none, none], ["token", "a", "b", "n", "before"])
            yield pa.record_batch([pa.array(token[many]), pa.array(doc[many]), pa.nulls(len(many), pa.int64()), pa.array(n[many]), pa.array(before[many])], ["token", "a", "b", "n", "before"])
            first = rows[:, starts[-1]]

    return run


# -- verification


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The intersection itself. ``x`` and ``y`` are sorted sets."""
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.begin("jaccard_join")
        last, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                a, b, text_a, text_b = (c.to_pylist() for c in batch.slice(at, 256).columns)
                keep = []
                for k, other in enumerate(shingles.sets(text_b)):
                    if text_a[k] != last:
                        last = text_a[k]
                        mine = next(shingles.sets([last]))
                    if len(mine) and len(other) and similar(mine, other, percent):
                        keep.append(k)
                yield pa.record_batch([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar. Only texts that a pair names are moved."""
    both = _beside(pairs, docs, {"text": "text"}).select("a", "b", "text_a", "text_b")
    with scratch.short_batches(docs.sparkSession, BATCH):
        return scratch.table(both.mapInArrow(_verify(percent), "a long, b long"), "verified")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Documents link when 100 * shared >= ``percent`` * union of their shingle sets. Null and empty texts, and texts of
    white space alone, have the empty set and link with nothing; a text of fewer than five words has its whole sequence
    as one shingle. Rows that share a doc_id are one node, so they share a component. A row without doc_id links with
    nothing and has a null component. Other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    frequent = scratch.broadcast(docs.sparkSession, frequent_tokens(base))
    rows = scratch.table(base.mapInArrow(_summarise(frequent, percent), SUMMARY), "sets")
    at = rows.where("size(prefix) > 0").select("doc_id", F.col("n").cast("long").alias("n"), "prefix", F.posexplode("prefix").alias("pos", "token"))
    # of the smaller of two similar sets the first shared token comes early, as at least so many are shared; n is negative elsewhere
    early = F.col("pos") <= F.col("n") - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}")
    before = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.get("prefix", F.col("pos") - 1))
    tokens = at.select("token", "doc_id", F.when(early, F.col("n")).otherwise(-F.col("n")).alias("n"), before.alias("before"))
    spread = tokens.repartition(F.col("token")).sortWithinPartitions("token", "doc_id")
    met = scratch.table(spread.mapInArrow(_pairs_of_tokens(percent), "token long, a long, b long, n long, before long"), "met")
    first = scratch.table(met.where("token is null").select("a", "b").distinct(), "first-pairs")
    pairs = plausible(first, rows, percent)
    scratch.drop(first)
    named = base.where("doc_id is not null")
    same = rows.where("same is not null").select(F.col("same").alias("a"), F.col("doc_id").alias("b"))
    found = verified(pairs, named, percent)
    links = scratch.table(found.unionAll(same), "links")
    scratch.drop(found)
    groups = components(links)
    # documents of large tokens that are in different components so far
    crowd = met.where("token is not null").select("token", F.col("a").alias("doc"), F.abs("n").alias("n"), (F.col("n") > 0).alias("early"), "before")
    crowd = crowd.join(groups.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    crowd = scratch.table(crowd, "crowd")
    ends = [f(c).alias(f"{name}_{c}") for c in ("component", "before") for name, f in (("lo", F.min), ("hi", F.max))]
    undecided = (F.col("lo_component") != F.col("hi_component")) & ((F.col("lo_before") != F.col("hi_before")) | (F.col("lo_before") == 0))
    mixed = crowd.groupBy("token").agg(F.max("early").alias("any"), *ends).where(undecided & F.col("any")).select("token")
    own = rows.where("same is null").select(F.col("doc_id").alias("doc"), "small")
    open_rows = scratch.table(crowd.join(mixed, "token", "left_semi").join(own, "doc"), "open-crowd")
    scratch.drop(crowd)
    if not open_rows.isEmpty():
        a, b = (open_rows.select(*[F.col(c).alias(c if c == "token" else f"{c}_{s}") for c in open_rows.columns]) for s in "ab")
        apart = (F.col("component_a") != F.col("component_b")) & (F.col("doc_a") < F.col("doc_b"))
        brought = (F.col("early_a") | (F.col("n_a") > F.col("n_b"))) & (F.col("early_b") | (F.col("n_b") > F.col("n_a")))
        fits = brought & ((F.col("before_a") != F.col("before_b")) | (F.col("before_a") == 0)) & small_allow("a", "b", percent)
        more = a.join(b, (a["token"] == b["token"]) & apart & fits).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()
        more = scratch.table(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        if not more.isEmpty():
            likely = plausible(more, rows, percent, begin=1)
            found = verified(likely, named, percent)
            if not found.isEmpty():
                scratch.drop(groups)
                groups = components(links.unionAll(found))
            scratch.drop(likely, found)
        scratch.drop(more)
    scratch.drop(met, pairs, links, open_rows)
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
