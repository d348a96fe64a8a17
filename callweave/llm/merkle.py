"""A Merkle manifest of a dataset: a tree of digests for each group, and one over the groups, with proofs for every row.

The leaves are ranked within their group, so a node is its level and its index there, and the group's size says how many
children it has. Parents wait for indexed children; the last one to arrive makes the parent's digest, which goes on to
its own parent at once. As the leaves lie in order of rank, a task settles nearly all that is above its rows without a
shuffle. Only its frontier, the nodes whose sisters other tasks have, is dealt anew, by ever longer runs of leaves.

Proofs go down again in blocks of 2**SPAN leaves: the sisters within a block are in its task, and what lies above the
block is the same for all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import scratch

#: Levels of a block.
SPAN = 12
#: The frontier is dealt by runs of 2**x leaves, in turn.
RUNS = (20, 32, 44, 62)
#: Rows of a task that ranks leaves, about.
TASK_ROWS = 500_000
#: (group, part) cells that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_CELLS = 200_000


def digest(text: Column) -> Column:
    """Lowercase hex of SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, or else the number of bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def height(n: int) -> int:
    """Levels above the leaves."""
    return max(n - 1, 0).bit_length()


def _join(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def ranked(leaves: DataFrame, group: Column, order: str) -> DataFrame:
    """``leaves`` (with a column digest) with grp, n (the group's leaves) and idx (the place among them).

    grp is a string in the order of the groups, null first; within a group the leaves go by ``order``, null first.

    They are sorted once, in ranges that ties and hot groups can't hold together, and written in that order, which
    makes the places final. The places within a range then need only the sizes of the ranges before.
    """
    rows = scratch.table(leaves.withColumn("__tie", F.monotonically_increasing_id()), "leaves")
    parts = max(1, -(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    grp = F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group.cast("string")))
    keys = [F.asc("grp"), F.asc_nulls_first(order), F.asc("digest"), F.asc("__tie")]
    laid = rows.withColumn("grp", grp).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = scratch.table(laid.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ranked")
    scratch.drop(rows)
    part = F.shiftright("__at", 33)
    cells = laid.groupBy("grp", part.alias("__part")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__from"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("grp", "__part", F.sum("n").over(whole).alias("n"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__from")).alias("__shift"))
    cells = scratch.table(cells, "cells")
    placed = laid.withColumn("__part", part)
    placed = placed.join(F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells, ["grp", "__part"])
    return placed.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__shift", "__part")


_NODES = "grp string, n long, level int, idx long, digest string, waiting boolean"
_NODES_ARROW = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("waiting", pa.bool_())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in any order; out go the nodes made at block levels and the groups' roots, and the frontier, waiting."""
    partial: dict[tuple[str, int, int], dict[int, str]] = {}
    sizes: dict[str, int] = {}

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _NODES_ARROW.types, strict=True)], schema=_NODES_ARROW)

    for batch in batches:
        out: list[tuple] = []
        for grp, n, level, idx, value in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "level", "idx", "digest")), strict=True):
            sizes[grp], top = n, height(n)
            if top == 0:
                out.append((grp, n, 0, 0, value, False))
            while level < top:
                parent = idx >> 1
                arity = min(2, ((n + (1 << level) - 1) >> level) - 2 * parent)
                got = partial.setdefault((grp, level, parent), {})
                got[idx] = value
                if len(got) < arity:
                    break
                del partial[grp, level, parent]
                value, level, idx = _join([got[i] for i in sorted(got)]), level + 1, parent
                if level % SPAN == 0 or level == top:
                    out.append((grp, n, level, idx, value, False))
        if out:
            yield rows(out)
    left = [(grp, sizes[grp], level, i, v, True) for (grp, level, _), got in partial.items() for i, v in got.items()]
    for at in range(0, len(left), 10_000):
        yield rows(left[at : at + 10_000])


def links(leaves: DataFrame) -> DataFrame:
    """grp, n, level, idx, digest of the groups' roots and of the nodes at block levels above the leaves.

    ``leaves``: grp, n, idx, digest, as ``ranked`` gives them.
    """
    nodes = leaves.select("grp", "n", F.lit(0).alias("level"), "idx", "digest")
    made = scratch.table(nodes.mapInArrow(_settle, _NODES), "links")
    out = made.where("not waiting")
    for run in RUNS:
        frontier = made.where("waiting")
        if frontier.isEmpty():
            break
        dealt = frontier.withColumn("run", F.expr(f"shiftright(shiftleft(idx, level), {run})")).repartition("grp", "run")
        made = scratch.table(dealt.drop("run").mapInArrow(_settle, _NODES), "links")
        out = out.unionByName(made.where("not waiting"))
    return out.drop("waiting")


STEP = "array<struct<on_left:boolean,digest:string>>"
_STEP = pa.struct([("on_left", pa.bool_()), ("digest", pa.string())])


def _proved(level: int, above: list[dict], subroot: str, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A block's nodes with their paths."""
    block = pa.Table.from_batches(pieces).sort_by("idx").combine_chunks().to_batches()[0]
    levels = [block.column("digest").to_pylist()]
    for _ in range(min(SPAN, height(block.column("n")[0].as_py()) - level)):
        now = levels[-1]
        levels.append([_join(now[i : i + 2]) for i in range(0, len(now), 2)])
    sides, digests, offsets = [], [], [0]
    over_sides, over_digests = [s["on_left"] for s in above], [s["digest"] for s in above]
    for i in range(block.num_rows):
        for now in levels[:-1]:
            sister = i ^ 1
            sides.append(sister < i)
            digests.append(now[sister] if sister < len(now) else None)
            i >>= 1
        sides += over_sides
        digests += over_digests
        offsets.append(len(sides))
    steps = pa.StructArray.from_arrays([pa.array(sides, pa.bool_()), pa.array(digests, pa.string())], fields=list(_STEP))
    path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
    kept = {c: block.column(c) for c in ("grp", "idx", "digest", "payload")}
    return pa.RecordBatch.from_pydict(kept | {"subroot": pa.array([subroot] * block.num_rows, pa.string()), "path": path})


def _prover(level: int):
    """For mapInArrow: of each block first what lies above it, then its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, above, subroot, pieces = None, [], "", []
        for batch in batches:
            keys = list(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a][:2] != key:
                    if pieces:
                        yield _proved(level, above, subroot, pieces)
                    key, pieces = keys[a][:2], []
                if keys[a][2] == 0:
                    above, subroot = batch.column("path")[a].as_py(), batch.column("subroot")[a].as_py()
                else:
                    pieces.append(batch.slice(a, b - a))
        if pieces:
            yield _proved(level, above, subroot, pieces)

    return run


def _height(n: str) -> Column:
    """``height`` of a column."""
    return F.when(F.col(n) <= 1, 0).otherwise(F.length(F.bin(F.col(n) - 1)))


def prove(leaves: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """grp, idx, digest, payload, subroot and path of the leaves (grp, n, idx, digest, payload).

    A path has a step for each level from the leaf up: whether the sister stands on the left, and its digest, null where
    there is none. ``found``: the leaves' ``links``; ``roots``: grp and path, what comes above each group's root.
    """
    tops = found.where(F.col("level") == _height("n")).select("grp", "n", F.col("digest").alias("subroot")).join(roots.select("grp", "path"), "grp")
    tops = scratch.table(tops, "tops")
    most = tops.agg(F.max("n")).first()[0] or 0
    none = {"payload": F.lit(None).cast("boolean")}
    current = None
    for level in range(max(height(most) - 1, 0) // SPAN * SPAN, -1, -SPAN):
        here = _height("n")
        nodes = leaves if level == 0 else found.where((F.col("level") == level) & (here > level)).withColumns(none)
        over = tops.where((here <= level + SPAN) & ((here > level) | F.lit(level == 0))).select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if current is not None:
            over = over.unionByName(current.select("grp", F.col("idx").alias("block"), "path", "subroot"))
        kind = dict(nodes.select("payload").dtypes)["payload"]
        own = nodes.select("grp", F.shiftright("idx", SPAN).alias("block"), F.lit(1).alias("kind"), "idx", "n", "digest", "payload", F.lit(None).cast(STEP).alias("path"), F.lit(None).cast("string").alias("subroot"))
        zero = F.lit(0).cast("long")
        over = over.select("grp", "block", F.lit(0).alias("kind"), zero.alias("idx"), zero.alias("n"), F.lit("").alias("digest"), F.lit(None).cast(kind).alias("payload"), "path", "subroot")
        dealt = own.unionByName(over).repartition("grp", "block").sortWithinPartitions("grp", "block", "kind")
        current = dealt.mapInArrow(_prover(level), f"grp string, idx long, digest string, payload {kind}, subroot string, path {STEP}")
    return current


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda now, s: digest(F.when(s["digest"].isNull(), now).when(s["on_left"], F.concat(s["digest"], now)).otherwise(F.concat(now, s["digest"])))
    return F.aggregate(path, leaf, step)


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """row (a struct of the columns of ``leaves``), leaf, subroot, root and path of every row.

    Of each group (a null one is a group too) the leaves stand by ``order``, null first, and those alike in it by their
    digests; rows that repeat all of it are leaves each. Nodes are joined by twos, a last one alone, until one is left,
    the subroot; a lone leaf is its own. The subroots, by their groups' UTF-8 bytes, null first, are joined likewise into
    the root. A path goes from the leaf through the subroot to the root, see ``prove``. An empty table gives an empty
    result. Names of other columns don't matter.
    """
    whole = leaves.select(F.struct("*").alias("payload"), F.col(group).alias("group"), F.col(order).alias("order"), F.col(leaf).alias("digest"))
    placed = scratch.table(ranked(whole, F.col("group"), "order").select("grp", "n", "idx", "digest", "payload"), "leaves")
    found = scratch.table(links(placed), "nodes")
    subroots = found.where(F.col("level") == _height("n")).select("digest", F.col("grp").alias("payload"))
    top = scratch.table(ranked(subroots, F.lit(""), "payload"), "subroots")
    over = links(top)
    root = over.where(F.col("level") == _height("n")).select("digest").first()  # one row or none
    above = prove(top, over, top.select("grp").distinct().withColumn("path", F.array().cast(STEP)))
    proved = prove(placed, found, scratch.table(above.select(F.col("payload").alias("grp"), "path"), "above"))
    return proved.select(F.col("payload").alias("row"), F.col("digest").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path")


def document_leaf(n_chars: Column) -> Column:
    """A document's leaf, with ``n_chars`` in the place of its column."""
    return digest(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text"))))
