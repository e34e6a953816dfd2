"""Hard negatives for anchors, with bounds passed along a spanning tree of the anchors.

The score of a row is its inner product with the anchor. If a and p are two anchors and c any
row, the scores of c differ by at most ``|a - p| * |c|``. Anchors are dealt into slices, and each
slice is joined by a minimum spanning tree. A block of rows walks the tree: at an anchor a row
has the bounds it had at the parent anchor, plus and minus edge distance times norm; where the
bounds overlap what is looked for, the row is scored exactly, else only its bounds go on.

Two walks over all rows are made. The first looks for scores above the least of the anchor's
best positives so far; the second, for scores in one of the windows that the positives open and
above the least of the best found there so far. Tasks keep the best few rows of each anchor and
window, and these are merged by Spark. Trees are broadcast, ``AT_ONCE`` slices (some 16 thousand
anchors) in a job, and each job's result is written to the shared folder: neither a task nor the
driver holds more, however many anchors there are, and rows are never copied for them.

Vectors are multiplied by ``scale`` and rounded down; all scores are exact whole numbers. Rules
for odd input: rows without id or label, without a vector, or with a component that is null or
not finite take no part; of several rows with one id, that with the smallest (label, vector)
does; a missing component of a shorter vector counts as zero; scaled components are cut to
±2^24, so that a score fits a long; an empty table, or one without anchors, gives no rows. Ties
go to the smaller id. Only the three columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeline.llm.common import partitions_of, ship
from strikeline.session import cut_lineage

#: Anchors in a slice and slices in a job.
SLICE = 1024
AT_ONCE = 16
#: Rows of a block.
BLOCK = 4096
_LARGEST = 2**24

_RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(
    rows: DataFrame, scale: float, id_column: str, vector: str, label: str
) -> DataFrame:
    """id, label, v (whole numbers) of the rows that take part, one for each id."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-_LARGEST), F.least(
        F.lit(_LARGEST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c.cast("double") * scale)))
    )).cast("int"))
    some = F.col(id_column).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
    chosen = rows.where(some).where(finite).select(
        F.col(id_column).cast("long").alias("id"),
        F.struct(F.col(label).cast("long").alias("label"), whole.alias("v")).alias("row"),
    )
    return chosen.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


# --- trees ------------------------------------------------------------------------


def matrix_of(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers as a matrix, short ones filled up with zeros."""
    sizes = np.asarray(pa.compute.list_value_length(vectors))
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning tree from row 0: parent and distance to it of every row."""
    n = len(vectors)
    x = vectors.astype(np.float64)
    squares = (x * x).sum(axis=1)
    parent, best = np.zeros(n, np.int64), np.full(n, np.inf)
    parent[0] = -1
    free, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        free[at] = False
        to = np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0)
        closer = free & (to < best)
        best[closer], parent[closer] = to[closer], at
        at = int(np.argmin(np.where(free, best, np.inf)))
    edges = vectors[1:] - vectors[parent[1:]]
    exact = np.sqrt((edges.astype(np.float64) ** 2).sum(axis=1))
    return parent, np.concatenate([[0.0], exact])


def walk_order(parent: np.ndarray) -> np.ndarray:
    """Rows from the root on, parents first, of siblings the largest subtree last: then the
    bounds of a few anchors only, the logarithm of all, are needed at any time."""
    children: list[list[int]] = [[] for _ in parent]
    root = 0
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            children[p].append(i)
        else:
            root = i
    down, stack = [], [root]
    while stack:
        at = stack.pop()
        down.append(at)
        stack += children[at]
    size = [1] * len(parent)
    for at in reversed(down):
        size[at] += sum(size[c] for c in children[at])
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += sorted(children[at], key=lambda c: -size[c])
    return np.array(order, np.int64)


def _tree(group: pa.Table) -> pa.Table:
    vectors = matrix_of(group["v"].combine_chunks())
    parent, edge = spanning_tree(vectors)
    order = walk_order(parent)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    above = np.where(parent >= 0, place[parent], -1)
    return pa.table({
        "slice": group["slice"], "place": place, "above": above, "edge": edge,
        "id": group["id"], "label": group["label"], "v": group["v"],
    })


def trees(anchors: DataFrame) -> DataFrame:
    """A row for each anchor: slice, place in the walk, place above (-1: none), edge, id, label, v."""
    slices = -(-anchors.count() // SLICE)
    return cut_lineage(
        anchors.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(max(1, slices))))
        .groupBy("slice").applyInArrow(
            _tree, "slice long, place long, above long, edge double, id long, label long, "
                   "v array<int>",
        )
    )


class Tree:
    """A slice in walking order."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["place"])
        self.above = [r["above"] for r in rows]
        self.edge = [r["edge"] for r in rows]
        self.ids = [r["id"] for r in rows]
        self.labels = [r["label"] for r in rows]
        self.vectors = matrix_of(pa.array([r["v"] for r in rows], pa.list_(pa.int32())))
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)).tolist()
        self.last = {p: i for i, p in enumerate(self.above)}  # the last child of each place


# --- the walk ------------------------------------------------------------------------


class Block:
    """Rows of a batch as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int) -> None:
        self.ids = batch["id"].to_numpy()
        self.labels = batch["label"].to_numpy()
        self.vectors = matrix_of(batch["v"], width)
        floats = self.vectors.astype(np.float64)
        self.norms = np.sqrt((floats**2).sum(axis=1))
        self.largest = float(np.abs(floats).max(initial=0))
        self._floats = floats

    def scores(self, vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        width = self.vectors.shape[1]
        a = np.zeros(width, np.int64)
        a[: len(vector)] = vector
        small = width * self.largest * float(np.abs(a).max(initial=0)) < 2**53
        x = self._floats if small else self.vectors
        a = a.astype(x.dtype)
        some = x[rows] @ a if 4 * len(rows) < len(x) else (x @ a)[rows]
        return some.astype(np.int64)


def walk(
    tree: Tree, block: Block, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor (by place) the rows that may be wanted there and their exact scores.

    ``wanted`` gets the place and the bounds of all rows and says which to score.
    """
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for place, above in enumerate(tree.above):
        # a little wider than the rule says, for the rounding of the bounds themselves
        slack = tree.norms[place] * block.norms * 1e-9 + 1
        if above < 0:
            reach = tree.norms[place] * block.norms + slack
            low, high = -reach, reach
        else:
            low, high = bounds[above]
            reach = tree.edge[place] * block.norms + slack
            low, high = low - reach, high + reach
            if tree.last[above] == place:
                del bounds[above]
        rows = np.flatnonzero(wanted(place, low, high))
        scores = block.scores(tree.vectors[place], rows)
        if place in tree.last:
            low[rows] = high[rows] = scores
            bounds[place] = low, high
        yield place, rows, scores


class Best:
    """The best (score, id) of several lists, at most ``size`` of each."""

    def __init__(self, size: int) -> None:
        self._size = size
        self._kept: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def least(self, key: tuple) -> float:
        """What a score must reach to be taken."""
        kept = self._kept.get(key)
        return float(kept[0][-1]) if kept and len(kept[0]) == self._size else -np.inf

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` fall, ids rise where they are equal."""
        if not len(scores):
            return
        scores, ids = scores[: self._size], ids[: self._size]
        if key in self._kept:
            scores = np.concatenate([self._kept[key][0], scores])
            ids = np.concatenate([self._kept[key][1], ids])
            order = np.lexsort((ids, -scores))[: self._size]
            scores, ids = scores[order], ids[order]
        self._kept[key] = scores, ids

    def items(self):
        return self._kept.items()


def _in_order(rows: np.ndarray, scores: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    ids = block.ids[rows]
    order = np.lexsort((ids, -scores))
    return scores[order], ids[order]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield Block(batch.slice(at, BLOCK), width)


def _positives(shared, size: int):
    """For ``mapInArrow``: the task's best rows of the anchor's label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, width = shared.value, max(t.vectors.shape[1] for t in shared.value)
        best = Best(size)
        for block in _blocks(batches, width):
            for n, tree in enumerate(kept):
                def wanted(place, low, high, tree=tree, n=n, block=block):
                    same = (block.labels == tree.labels[place]) & (block.ids != tree.ids[place])
                    return same & (high >= best.least((n, place)))

                for place, rows, scores in walk(tree, block, wanted):
                    best.add((n, place), *_in_order(rows, scores, block))
        for (n, place), (scores, ids) in best.items():
            yield pa.RecordBatch.from_pydict({
                "anchor_id": [kept[n].ids[place]] * len(ids), "other_id": ids, "score": scores,
            })

    return run


def _negatives(shared, size: int, low_share: int, high_share: int):
    """For ``mapInArrow``: the task's best rows of other labels in each window. ``shared``: the
    trees, and by anchor the scores of its positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, opened = shared.value
        width = max(t.vectors.shape[1] for t in kept)
        best = Best(size)

        def windows(anchor: int) -> list[tuple[int, int, int]]:
            """Positive score, least and greatest whole score of the window."""
            return [(s, -(-low_share * s // 100), high_share * s // 100) for s in opened.get(anchor, ())]

        ranges = [[windows(i) for i in tree.ids] for tree in kept]
        for block in _blocks(batches, width):
            for n, tree in enumerate(kept):
                def wanted(place, low, high, tree=tree, n=n, block=block):
                    own = [w for w in ranges[n][place] if w[1] <= w[2]]
                    if not own:
                        return np.zeros(len(low), bool)
                    floor = min(max(w[1], best.least((n, place, w[0]))) for w in own)
                    overlap = (high >= floor) & (low <= max(w[2] for w in own))
                    return overlap & (block.labels != tree.labels[place])

                for place, rows, scores in walk(tree, block, wanted):
                    scores, ids = _in_order(rows, scores, block)
                    for score, least, most in ranges[n][place]:
                        a = np.searchsorted(-scores, -most, "left")
                        b = np.searchsorted(-scores, -least, "right")
                        best.add((n, place, score), scores[a:b], ids[a:b])
        for (n, place, score), (scores, ids) in best.items():
            yield pa.RecordBatch.from_pydict({
                "anchor_id": [kept[n].ids[place]] * len(ids),
                "positive_score": [score] * len(ids), "other_id": ids, "score": scores,
            })

    return run


def _ranked(found: DataFrame, size: int, *keys: str) -> DataFrame:
    """The best of what the tasks have kept; a group has ``size`` rows for each task at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(
    rows: DataFrame, is_anchor: Column | None = None, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: float = 256.0, id_column: str = "vec_id",
    vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each anchor (default: ids divisible by 100) and each of its ``positives`` best other
    rows of its label: the ``negatives`` best rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    candidates = cut_lineage(
        usable(rows, scale, id_column, vector, label).repartition(partitions_of(spark))
    )
    condition = F.col("id") % 100 == 0 if is_anchor is None else is_anchor
    planted = trees(candidates.where(condition))
    context = spark.sparkContext
    done = []
    slices = planted.agg(F.max("slice")).first()[0]
    for first in range(0, 0 if slices is None else slices + 1, AT_ONCE):
        mine_now = planted.where(F.col("slice").between(first, first + AT_ONCE - 1))
        by_slice: dict[int, list] = {}
        for row in mine_now.collect():  # some AT_ONCE * SLICE anchors
            by_slice.setdefault(row["slice"], []).append(row)
        if not by_slice:
            continue
        grown = [Tree(r) for _, r in sorted(by_slice.items())]
        near = cut_lineage(_ranked(
            candidates.mapInArrow(
                _positives(context.broadcast(grown), positives),
                "anchor_id long, other_id long, score long",
            ), positives, "anchor_id",
        ).select(
            "anchor_id", F.col("other_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ))
        opened: dict[int, tuple] = {}
        for row in near.select("anchor_id", "positive_score").distinct().collect():
            opened[row.anchor_id] = (*opened.get(row.anchor_id, ()), row.positive_score)
        far = _ranked(
            candidates.mapInArrow(
                _negatives(context.broadcast((grown, opened)), negatives, low, high),
                "anchor_id long, positive_score long, other_id long, score long",
            ), negatives, "anchor_id", "positive_score",
        )
        # positives with one score share a window
        done.append(cut_lineage(near.join(far, ["anchor_id", "positive_score"]).select(
            "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )))
    if not done:
        names = ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in _RESULT)
        return spark.createDataFrame([], names)
    return reduce(DataFrame.unionByName, done)


#: The rows of the query in SQL: every anchor with every row.
MINED_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
