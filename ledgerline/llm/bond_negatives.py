"""Hard negatives by BOND: branch and bound over vertically stored vectors.

Vectors become integers (floor of 256 times each component) and scores are
integer inner products, so every comparison is exact. Rows are dealt into
blocks of about ``BLOCK_ROWS`` by a hash of their id; a block is stored by
dimension, one array per dimension with its least and largest value, its rows
in order of label. Anchors travel in blocks of about ``BLOCK_ANCHORS``.

An anchor reads the dimensions of a block in descending order of its own
components' magnitude, first a part of them, then ``STEP`` at a time. After each
step the dimensions not read yet can add at least and at most what their least and largest values
give; rows whose range of scores can't matter any more leave the candidate
bitmap, and the others get the next dimensions. Two scans:

1. positives: the rows of the anchor's label, kept while their upper bound
   reaches the k-th best lower bound of the block;
2. negatives: the rows of the other labels, kept while their range meets one
   of the anchor's score windows (``LOW`` to ``HIGH`` percent of a positive's
   score) and fewer than k rows that are surely inside have a better lower bound.

What a scan leaves of a block is exact, and the best of all blocks are the
result. The anchors are a stated query set that meets all rows, block by
block: Spark joins blocks, never rows, and a task holds one block of each at a
time. Anchors are copied once per row block, a small part of the work that
the block then is.

Defined results: rows with a null vec_id, label or vector, or with a null or
non-finite component, take no part. A shorter vector counts as ending in
zeros. Rows with equal vec_id are one row: the least by (label, vector).
Positives with a negative score have an empty window, those with score 0 a
window of 0 only. Components beyond 2^40 are an error, as scores are 64-bit.
An empty table, or one without anchors, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative's score lies between so many percent of the positive's.
LOW, HIGH = 50, 95
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 256
# Shuffle partitions of the block pairs: one per row block up to this many.
MOST_TASKS = 20_000
# Dimensions read between two looks at the bounds; before the first look, this part of them: bounds of fewer rarely decide.
STEP, AT_ONCE = 8, 0.6
LARGEST = float(1 << 40)

BLOCK = "block long, ids binary, labels binary, cells array<binary>"
PAIRS = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, cells): the rows that take part, one per vec_id."""
    vector = embeddings["embedding"]
    cells = F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = F.forall(vector, lambda x: F.abs(SCALE * x.cast("double")) < LARGEST)
    rows = embeddings.where(embeddings["vec_id"].isNotNull() & embeddings["label"].isNotNull() & vector.isNotNull()
                            & usable).select(
        embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].cast("long").alias("label"),
        F.when(held, cells).otherwise(F.raise_error(F.lit("a vector component is too large for 64-bit scores")))
        .alias("cells"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "cells")).alias("r")).select("vec_id", "r.*")


def shifted_labels(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Label (label + 1) % ``labels`` where ``every`` divides vec_id: some labels are wrong, as in real data."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels)
                           .otherwise(F.col("label")))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows gathered into ``blocks`` blocks by a hash of their id, whatever their labels."""
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("block")
    return rows.groupBy(number).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))


def _vertical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by dimension, rows in order of (label, vec_id)."""
    for batch in batches:
        for block, rows in zip(batch["block"].to_pylist(), batch["rows"], strict=True):
            ids, labels, cells = _matrix(rows.values)
            order = np.lexsort((ids, labels))
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()),
                pa.array([labels[order].tobytes()], pa.binary()),
                pa.array([[column[order].tobytes() for column in cells]], pa.list_(pa.binary()))],
                names=["block", "ids", "labels", "cells"])


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the components by dimension (short vectors end in zeros)."""
    vectors = rows.field("cells")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max()) if len(sizes) else 0
    cells = np.zeros((wide, len(sizes)), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    cells[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return rows.field("vec_id").to_numpy(), rows.field("label").to_numpy(), cells


class Block:
    """Rows stored by dimension, in order of label."""

    def __init__(self, ids: bytes, labels: bytes, cells: list[bytes]):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.cells = np.stack([np.frombuffer(c, np.int64) for c in cells]) if cells else np.zeros((0, len(self.ids)), np.int64)
        # Sums of products below 2^53 are exact in doubles; larger ones are counted in Python's integers.
        self.least, self.largest = self.cells.min(axis=1), self.cells.max(axis=1)
        self.top = int(max(-self.least.min(), self.largest.max(), 1)) if cells else 1
        self.floats = self.cells.astype(np.float64)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def scan(anchor: np.ndarray, block: Block, rows: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of the ``rows`` (places in the block) that ``keep(lower, upper)`` never lets go.

    ``keep`` gets bounds of the scores of the rows left and returns its bitmap over them.
    """
    wide = min(len(anchor), len(block.cells))
    anchor = anchor[:wide]
    order = np.argsort(-np.abs(anchor), kind="stable")
    exact = wide * int(np.abs(anchor).max(initial=1)) * block.top < 1 << 53
    kind, cells = (np.float64, block.floats) if exact else (object, block.cells.astype(object))
    weights = anchor.astype(kind)
    one, other = weights * block.least[:wide].astype(kind), weights * block.largest[:wide].astype(kind)
    low, high = np.minimum(one, other)[order], np.maximum(one, other)[order]
    # What the dimensions from place m on can still add.
    low, high = (np.append(np.cumsum(x[::-1])[::-1], kind(0) if exact else 0) for x in (low, high))
    end = min(wide, max(STEP, int(AT_ONCE * wide)))
    scores = (weights[order[:end]] @ cells[order[:end]])[rows] if wide else np.zeros(len(rows), kind)
    while len(rows):
        left = keep(scores + low[end], scores + high[end])
        if not left.all():
            rows, scores = rows[left], scores[left]
        if end == wide or not len(rows):
            break
        read = order[end:end + STEP]
        end = min(end + STEP, wide)
        scores = scores + weights[read] @ cells[np.ix_(read, rows)]
    if not exact and len(scores) and max(map(abs, scores)) >= 1 << 63:
        raise OverflowError("a score is too large for 64 bits")
    return rows, scores.astype(np.int64)


def best(k: int) -> Callable:
    """Rows that may be among the k best."""
    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]
    return keep


def best_in_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    """Rows that may be among the k best of the scores within one of the windows, bounds included."""
    lowest = min((least for least, _ in windows), default=0)
    highest = max((most for _, most in windows), default=-1)

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        left = (upper >= lowest) & (lower <= highest)
        if not windows or lower.max(initial=lowest - 1) < lowest:  # no row is surely inside a window yet
            return left if windows else np.zeros(len(lower), bool)
        at = np.flatnonzero(left)
        lower, upper, wanted = lower[at], upper[at], np.zeros(len(at), bool)
        for least, most in windows:
            may = (upper >= least) & (lower <= most)
            inside = lower[(lower >= least) & (upper <= most)]
            if len(inside) >= k:
                may &= upper >= np.partition(inside, len(inside) - k)[len(inside) - k]
            wanted |= may
        left[at] = wanted
        return left
    return keep


def window_of(score: int) -> tuple[int, int]:
    """The least and largest whole negative score within LOW to HIGH percent of ``score``."""
    return -(-LOW * score // 100), HIGH * score // 100


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _positives(anchor_id: int, label: int, vector: np.ndarray, _, block: Block) -> Iterator[tuple]:
    part = block.of_label(label)
    rows = np.arange(part.start, part.stop)
    rows, scores = scan(vector, block, rows[block.ids[rows] != anchor_id], best(POSITIVES))
    for i in _first(block.ids[rows], scores, POSITIVES):
        yield anchor_id, None, None, int(block.ids[rows[i]]), int(scores[i])


def _negatives(anchor_id: int, label: int, vector: np.ndarray, positives: list[dict], block: Block) -> Iterator[tuple]:
    part = block.of_label(label)
    rows = np.concatenate([np.arange(part.start), np.arange(part.stop, len(block.ids))])
    windows = [window_of(p["score"]) for p in positives]
    rows, scores = scan(vector, block, rows, best_in_windows([w for w in windows if w[0] <= w[1]], NEGATIVES))
    for positive, (least, most) in zip(positives, windows, strict=True):
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        for i in inside[_first(block.ids[rows[inside]], scores[inside], NEGATIVES)]:
            yield anchor_id, positive["other_id"], positive["score"], int(block.ids[rows[i]]), int(scores[i])


def _scanned(anchors: DataFrame, rows: DataFrame, find: Callable) -> DataFrame:
    """``find`` on every anchor and every row block; anchors: (block, anchors), rows: BLOCK."""
    kinds = [pa.int64()] * 5
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch["ids"][i].as_py(), batch["labels"][i].as_py(), batch["cells"][i].as_py())
                group = batch["anchors"][i].values
                ids, labels, cells = _matrix(group)
                positives = group.field("positives").to_pylist() if "positives" in [f.name for f in group.type] else [()] * len(ids)
                found = [row for a in range(len(ids))
                         for row in find(int(ids[a]), int(labels[a]), cells[:, a], positives[a], block)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    # Blocks meet blocks: a pair is one row, with a block of anchors and one of rows.
    return anchors.join(rows, "block").mapInArrow(task, PAIRS)


def _anchor_blocks(anchors: DataFrame, n: int, blocks: int) -> DataFrame:
    """Blocks of anchors, a copy for each of the row blocks."""
    groups = _dealt(anchors, max(1, -(-n // BLOCK_ANCHORS))).select(F.col("rows").alias("anchors"))
    return groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).repartition(
        min(blocks, MOST_TASKS), "block")


def _numbered(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group by descending score, then id, with their rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "other_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """Hard negatives of the ``rows`` (vec_id, label, cells) for which ``is_anchor`` holds.

    One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = written(rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "bond-rows")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks = max(1, -(-n // BLOCK_ROWS))
    vertical = written(_dealt(rows.drop("anchor"), blocks).mapInArrow(_vertical, BLOCK), "bond-blocks")
    vertical = vertical.repartition(min(blocks, MOST_TASKS), "block")
    anchors = rows.where("anchor").drop("anchor")

    nearest = _numbered(_scanned(_anchor_blocks(anchors, n_anchors, blocks), vertical, _positives), ["anchor_id"], POSITIVES)
    nearest = nearest.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("positives"))
    ready = written(anchors.join(nearest, anchors["vec_id"] == nearest["anchor_id"]).drop("anchor_id"), "bond-anchors")
    found = _scanned(_anchor_blocks(ready, n_anchors, blocks), vertical, _negatives)
    best_of = _numbered(found, ["anchor_id", "positive_id"], NEGATIVES)
    return best_of.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
                          "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The negatives of all anchors (``every`` divides vec_id), with some labels shifted."""
    rows = shifted_labels(integer_rows(embeddings))
    return mine(rows, F.col("vec_id") % every == 0)
