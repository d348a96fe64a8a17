"""Hard negatives: for anchors and their nearest rows of the same label, the nearest rows of other labels in a score window.

The rows are dealt into parts of bounded size, and each part's task builds a ball tree of them. The anchors are the
stated query set: they are sent to every part, in a stream, and searched in batches. A ball's centre and radius bound
the inner products of all that is in it from above and from below, so a node is left out where the whole of it lies
outside the windows or strictly beneath the kth best so far. Parts give k rows for each question at most, and a ranking
that Spark limits before it shuffles joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import scratch

#: Components are counted in 256ths.
SCALE = 256.0
#: Rows of a leaf at most.
LEAF = 128
#: Components that a part's tree holds, about: 64 MB.
PART_VALUES = 1 << 23
#: Anchors that are searched together.
BATCH = 1024
#: Integers below it are exact in float64.
EXACT = 2.0**53
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class BallTree:
    """A binary tree of balls over the rows of a matrix, halved across the longest line that is easily found."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        spans, centers, radii, kids = [(0, len(ids))], [], [], []
        at = 0
        while at < len(spans):
            lo, hi = spans[at]
            own = points[order[lo:hi]]
            center = own.mean(axis=0)
            away = ((own - center) ** 2).sum(axis=1)
            centers.append(center)
            radii.append(np.sqrt(away.max()))
            if hi - lo <= LEAF:
                kids.append((-1, -1))
            else:
                far = own[away.argmax()]
                line = own[((own - far) ** 2).sum(axis=1).argmax()] - far
                half = (hi - lo) // 2
                if line.any():  # copies of one vector stay in the order of their ids
                    order[lo:hi] = order[lo:hi][np.argpartition(own @ line, half)]
                kids.append((len(spans), len(spans) + 1))
                spans += [(lo, lo + half), (lo + half, hi)]
            at += 1
        self.spans, self.kids = spans, kids
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]
        self.least = np.array([self.labels[lo:hi].min() for lo, hi in spans])
        self.most = np.array([self.labels[lo:hi].max() for lo, hi in spans])
        self.largest = float(np.abs(points).max(initial=0.0))

    def search(self, queries: np.ndarray, own: np.ndarray, own_ids: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """scores and ids, (queries, windows, k), of the best rows within ``low`` and ``high`` (queries, windows).

        ``same``: only rows of the query's label count, or else only those of others; the row of the query's own id
        never does. Best first, ties by the smaller id; a score of minus infinity stands where there is no row.
        """
        exact = self.points.shape[1] * self.largest * float(np.abs(queries).max(initial=0.0)) < EXACT
        kind = np.float64 if exact else object
        rows, points = queries, self.points
        if not exact:
            rows, points = _whole(queries), _whole(self.points)
        shape = (*low.shape, k)
        scores, ids = np.full(shape, -np.inf, dtype=kind), np.full(shape, LONG_MAX, dtype=np.int64)
        lengths = np.sqrt((queries**2).sum(axis=1))
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, active = stack.pop()
            middle = queries[active] @ self.centers[node]
            # what rounding may have taken from the bounds
            reach = lengths[active] * self.radii[node] + 1e-9 * lengths[active] * (self.norms[node] + self.radii[node]) + 1e-6
            least = np.maximum(low[active], scores[active, :, -1].astype(np.float64))
            may = ((middle - reach)[:, None] <= high[active]) & ((middle + reach)[:, None] >= least)
            keep = may.any(axis=1)
            if same:
                keep &= (own[active] >= self.least[node]) & (own[active] <= self.most[node])
            else:
                keep &= (self.least[node] != self.most[node]) | (own[active] != self.least[node])
            active = active[keep]
            if not len(active):
                continue
            left, right = self.kids[node]
            if left >= 0:
                nearer = queries[active].sum(axis=0) @ (self.centers[left] - self.centers[right]) >= 0
                stack += [(right, active), (left, active)] if nearer else [(left, active), (right, active)]
                continue
            lo, hi = self.spans[node]
            found = rows[active] @ points[lo:hi].T
            mine = own[active][:, None] == self.labels[None, lo:hi]
            fit = (mine if same else ~mine) & (own_ids[active][:, None] != self.ids[None, lo:hi])
            for w in range(low.shape[1]):
                last, last_id = scores[active, w, -1][:, None], ids[active, w, -1][:, None]
                good = fit & (found >= low[active, w][:, None]) & (found <= high[active, w][:, None])
                good = good & ((found > last) | ((found == last) & (self.ids[None, lo:hi] < last_id)))
                q, r = np.nonzero(good)
                if len(q):
                    _merge(scores, ids, active[q], w, found[q, r], self.ids[lo + r], k)
        return scores, ids


def _whole(values: np.ndarray) -> np.ndarray:
    """The same as Python's integers, for sums that float64 can't hold exactly."""
    return np.frompyfunc(int, 1, 1)(values) if values.size else values.astype(object)


def _merge(scores: np.ndarray, ids: np.ndarray, q: np.ndarray, w: int, new: np.ndarray, new_ids: np.ndarray, k: int) -> None:
    """Put candidates among the k best of their questions."""
    asked = np.unique(q)
    all_q = np.concatenate([np.repeat(asked, k), q])
    all_s = np.concatenate([scores[asked, w].ravel(), new])
    all_i = np.concatenate([ids[asked, w].ravel(), new_ids])
    if all_s.dtype == object:
        order = np.array(sorted(range(len(all_q)), key=lambda x: (all_q[x], -all_s[x], all_i[x])))
    else:
        order = np.lexsort((all_i, -all_s, all_q))
    first = np.searchsorted(all_q[order], asked)
    take = order[first[:, None] + np.arange(k)[None, :]]
    scores[asked, w], ids[asked, w] = all_s[take], all_i[take]


def _floors(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in the batch of the vectors of each length, and a matrix of them."""
    vectors = batch.column("vector")
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        mine = lengths == n
        yield np.flatnonzero(mine), _floors(flat[np.repeat(mine, lengths)]).reshape(int(mine.sum()), int(n))


OUT = "anchor_id long, positive_id long, positive_score long, found_id long, score long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in OUT.split(", ")])


def _searcher(k: int, low: int, high: int):
    """For mapInArrow: of each part first its rows, then the anchors.

    Anchors without positives look for these; others for negatives, in a window for each positive.
    """

    def windows(scores: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        most = max(map(len, scores), default=0)
        lo, hi = np.full((len(scores), most), np.inf), np.full((len(scores), most), -np.inf)
        lo, hi = (lo, hi) if all(abs(s) < EXACT / 100 for x in scores for s in x) else (lo.astype(object), hi.astype(object))
        for i, own in enumerate(scores):
            for j, s in enumerate(own):
                lo[i, j], hi[i, j] = -(-low * s // 100), high * s // 100
        return lo, hi

    def answers(trees: dict[int, BallTree], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        given = batch.column("positives").to_pylist()
        for places, queries in _by_length(batch):
            tree = trees.get(queries.shape[1])
            if tree is None:
                continue
            for at in range(0, len(places), BATCH):
                own = places[at : at + BATCH]
                positives = [given[i] for i in own]
                same = positives[0] is None
                lo, hi = (np.full((len(own), 1), x) for x in (-np.inf, np.inf)) if same else windows([[p["score"] for p in x] for x in positives])
                scores, found = tree.search(queries[at : at + BATCH], labels[own], ids[own], same, lo, hi, k)
                q, w, n = np.nonzero(scores > -np.inf)
                score = np.array([min(max(int(s), LONG_MIN), LONG_MAX) for s in scores[q, w, n]], dtype=np.int64) if scores.dtype == object else scores[q, w, n].astype(np.int64)
                asked = [(None, None)] * len(q) if same else [(positives[a][b]["id"], positives[a][b]["score"]) for a, b in zip(q, w, strict=True)]
                columns = [ids[own][q], [a for a, _ in asked], [b for _, b in asked], found[q, w, n], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, trees = None, [], None
        for batch in batches:
            keys = batch.column("part").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                piece, own = batch.slice(a, b - a), int(keys[a]) // 2
                if own != part:
                    part, rows, trees = own, [], None
                if keys[a] % 2 == 0:
                    ids, labels = piece.column("vec_id").to_numpy(), piece.column("label").to_numpy()
                    rows += [(m.shape[1], ids[i], labels[i], m) for i, m in _by_length(piece)]
                    continue
                if trees is None:
                    trees = {n: BallTree(*(np.concatenate([r[c] for r in rows if r[0] == n]) for c in (1, 2, 3))) for n in {r[0] for r in rows}}
                    rows = []
                yield from answers(trees, piece)

    return run


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and vector of the rows that take part.

    Not those in which one of the three or a component is null or a component isn't finite. Rows that share a vec_id
    count as one, that of the least label and then vector; they are combined before they are shuffled.
    """
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("vector"))
    named = named.dropna().where(~odd)
    return named.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def _answers(rows: DataFrame, anchors: DataFrame, parts: int, k: int, low: int, high: int) -> DataFrame:
    """Each part's answers to the anchors (vec_id, label, vector, positives)."""
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    mine = rows.select(part.alias("part"), F.lit(0).alias("kind"), "vec_id", "label", "vector", none.alias("positives"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "vec_id", "label", "vector", "positives")
    dealt = mine.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(_searcher(k, low, high), OUT)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, part_values: int = PART_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``rows``: vec_id, label, vector, as ``usable`` gives them.

    An anchor's positives are its ``positives`` best other rows of the same label. For each of them the ``negatives``
    best rows of other labels are taken whose score is from ``low`` to ``high`` hundredths of the positive's score.
    The score is the inner product of the components' floors in 256ths; ties go by the smaller vec_id. Vectors of
    different lengths have no score and don't meet; empty vectors have the score 0. A score beyond a long is held at
    the long's limit, and so is the window made of it. Fewer rows than asked for, or none, are what there is; an anchor without them has no row. An
    empty table gives an empty result. Other columns than the three are ignored.

    The parts are as many as the rows need for trees of about ``part_values`` components, and enough for all cores.
    Rows are read twice, from a table in the shared folder: for the positives, and for the negatives.
    """
    spark = rows.sparkSession
    rows = scratch.table(rows.select("vec_id", "label", "vector"), "vectors")
    n, wide = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    parts = max(1, -(-n * max(wide, 1) // part_values), min(2 * spark.sparkContext.defaultParallelism, n // LEAF))
    anchors = rows.where(is_anchor)
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    found = _answers(rows, anchors.withColumn("positives", none), parts, positives, low, high)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    each = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("found_id").alias("id"), "score")).alias("positives"))
    asked = scratch.table(anchors.join(each, "vec_id"), "anchors")
    found = _answers(rows, asked, parts, negatives, low, high)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
