"""Nearest vectors by cosine: blocked products, and a bounded heap for each query. An extension.

The rows are dealt into blocks of a bounded number of components. Each query is sent to every block, in a stream; a task
holds one block as a matrix, multiplies batches of queries with it, and keeps the k best of each query by partial
selection, so what leaves a block is k rows for each query at most. These partial results merge: Spark limits them to k
before and after it shuffles them by query. No pair beyond them is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.plans.cut import cut

#: Components of a block, about: 64 MB.
BLOCK_VALUES = 1 << 23
#: Queries that are multiplied with a block at once.
BATCH = 512
#: Decimals of a similarity; what is equal in them is a tie.
DECIMALS = 9


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector of the rows that have a direction: all components are there and finite, and one isn't zero."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).dropna()
    return named.where(~odd & F.exists("vector", lambda x: x != 0))


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of the vectors of each length, and a matrix of their directions."""
    vectors, ids = batch.column("vector"), batch.column("id").to_numpy()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        mine = lengths == n
        points = flat[np.repeat(mine, lengths)].reshape(-1, int(n))
        points = points / np.abs(points).max(axis=1, keepdims=True)  # so that no square is beyond a double
        yield ids[mine], points / np.sqrt((points**2).sum(axis=1, keepdims=True))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row of ``scores``, ties by the smaller id; in no order.

    A partial selection finds the kth score; of those that tie with it the smallest ids are taken.
    """
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    order = np.argsort(ids, kind="stable")
    above, tied = scores > last, (scores == last)[:, order]
    missing = k - above.sum(axis=1, keepdims=True)
    tied &= np.cumsum(tied, axis=1) <= missing
    taken = above
    taken[:, order] |= tied
    return np.nonzero(taken)[1].reshape(len(scores), k)


OUT = "query_id long, id long, similarity double"


def _multiply(k: int):
    """For mapInArrow: of each block first its rows, then the queries."""

    def answers(block: dict[int, tuple[np.ndarray, np.ndarray]], queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for query_ids, points in _units(queries):
            if (own := block.get(points.shape[1])) is None:
                continue
            ids, matrix = own
            for at in range(0, len(query_ids), BATCH):
                asked = query_ids[at : at + BATCH]
                scores = np.round(points[at : at + BATCH] @ matrix.T, DECIMALS) + 0.0
                scores[asked[:, None] == ids[None, :]] = -np.inf
                best = best_of(scores, ids, k)
                q = np.repeat(np.arange(len(asked)), best.shape[1])
                found = scores[q, best.ravel()]
                real = found > -np.inf
                yield pa.RecordBatch.from_pydict({"query_id": asked[q][real], "id": ids[best.ravel()][real], "similarity": found[real]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, block = None, {}, None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] // 2 != current:
                    current, pieces, block = keys[a] // 2, {}, None
                if keys[a] % 2 == 0:
                    for ids, points in _units(batch.slice(a, b - a)):
                        pieces.setdefault(points.shape[1], []).append((ids, points))
                    continue
                if block is None:
                    block = {n: tuple(np.concatenate(x) for x in zip(*p, strict=True)) for n, p in pieces.items()}
                    pieces = {}
                yield from answers(block, batch.slice(a, b - a))

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank (from 1), id, similarity of the k rows nearest to each query, by cosine. Both: id, vector, as ``usable`` gives them.

    Similarities are rounded to DECIMALS, ties go by the smaller id; the row of the query's own id doesn't count. Vectors
    of different lengths don't meet. Fewer than k rows are what there is. Rows that repeat an id count each. Queries may be
    as many as rows: both are only ever in blocks.
    """
    rows = cut(rows.select("id", "vector"))
    n, wide = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    blocks = max(1, -(-n * wide // block_values), min(2 * rows.sparkSession.sparkContext.defaultParallelism, n // BATCH))
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "vector")
    dealt = own.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(_multiply(k), OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
