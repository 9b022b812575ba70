"""Hard negatives of labelled vectors: rows of another label that score nearly as high as a positive.

Scores are inner products of whole numbers, so they are exact and equal on every machine.  All rows are dealt into
blocks of a bounded size by a hash of their id, a partition each; every anchor visits each block.  There its scores
with the whole block are sorted, and what each block finds is merged: the first of all rows are among the first of
each block.  Two such passes are made: the first finds each anchor's positives among the rows of its label,
the second reads the negatives below each positive's score.

A task holds one block and a lot of anchors at a time, whatever label or vector is frequent.  What is shuffled is each
row once and each anchor once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import stored
from ._vectors import finite, integers, matrix, products

BLOCK = 65_536  # rows a block at most, nearly
LEAST = 2_048  # rows for which another task is worth while
CELLS = 4 << 20  # scores held at a time


class _Block:
    """The rows of one block in order of their ids, and per label where its rows are."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        self.width = width
        self.ids = rows["id"].to_numpy()
        self.vectors = matrix(rows["v"], width)
        self.labels = rows["label"].to_numpy()
        order = np.argsort(self.labels, kind="stable")
        names, first = np.unique(self.labels[order], return_index=True)
        self.of_label = dict(zip(names.tolist(), np.split(order, first[1:]), strict=True)) if len(names) else {}

    def lots(self, anchors: pa.Table) -> Iterator[pa.Table]:
        """Runs of anchors whose scores with the whole block fit CELLS."""
        step = max(1, CELLS // max(1, len(self.ids)))
        for k in range(0, anchors.num_rows, step):
            yield anchors.slice(k, step)


def _positives(block: _Block, anchors: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    """Per anchor the first rows of its own label, itself left out."""
    for lot in block.lots(anchors):
        own_ids, labels, vectors = lot["id"].to_numpy(), lot["label"].to_numpy(), matrix(lot["v"], block.width)
        found: list[tuple[np.ndarray, ...]] = []
        for label in np.unique(labels).tolist():
            rows = block.of_label.get(label, np.zeros(0, np.int64))
            asked = np.flatnonzero(labels == label)
            ids, scores = block.ids[rows], products(vectors[asked], block.vectors[rows])
            for k, a in enumerate(asked):
                order = np.lexsort((ids, -scores[k]))
                order = order[ids[order] != own_ids[a]][:most]
                found.append((np.full(len(order), own_ids[a]), ids[order], scores[k][order]))
        if found:
            yield pa.record_batch([np.concatenate(c) for c in zip(*found, strict=True)], ["anchor_id", "positive_id", "positive_score"])


def _negatives(block: _Block, anchors: pa.Table, most: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Per anchor and positive the first rows of other labels within the limits, read from the sorted scores."""
    for lot in block.lots(anchors):
        own_ids, labels = lot["id"].to_numpy(), lot["label"].to_numpy()
        scores = products(matrix(lot["v"], block.width), block.vectors)
        found: list[tuple[np.ndarray, ...]] = []
        for k, positives in enumerate(lot["positives"].to_pylist()):
            order = np.lexsort((block.ids, -scores[k]))
            order = order[block.labels[order] != labels[k]]
            down = -scores[k][order]  # ascending
            for p in positives:
                top, least = high * p["score"] // 100, -(-low * p["score"] // 100)
                first = np.searchsorted(down, -top, side="left")
                end = min(first + most, np.searchsorted(down, -least, side="right"))
                rows = order[first:end]
                found.append((np.full(len(rows), own_ids[k]), np.full(len(rows), p["id"]), np.full(len(rows), p["score"]), block.ids[rows], scores[k][rows]))
        if found:
            yield pa.record_batch([np.concatenate(c) for c in zip(*found, strict=True)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _visit(rows: DataFrame, anchors: DataFrame, blocks: int, width: int, found, schema: str) -> DataFrame:
    """What ``found`` (block, anchors) yields where each anchor meets each block.

    A partition is one block, its rows sorted before the anchors: the rows are held, the anchors stream past.
    """
    everywhere = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    own = rows.withColumn("side", F.lit(0))
    both = own.unionByName(everywhere, allowMissingColumns=True)
    dealt = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        block = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            before = int(np.searchsorted(part["side"].to_numpy(), 1))
            if before:
                held.append(part.slice(0, before))
            if before < part.num_rows:
                block = block or _Block(pa.concat_tables(held or [part.slice(0, 0)]), width)
                held = []
                yield from found(block, part.slice(before))

    return dealt.mapInArrow(run, schema)


def hard_negatives(vectors: DataFrame, *, anchors: str, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; no other columns.

    Each component becomes floor(``scale`` * x); a score is the inner product with the anchor, the higher the
    better, of equal ones the smaller id.  Anchors are the rows that satisfy the SQL condition ``anchors``.  Their positives
    are the first ``positives`` other rows of the same label.  For each of these, the first ``negatives`` rows of
    other labels follow whose score is from ``low`` to ``high`` percent of the positive's, ranked from 1.  An
    anchor without positives or a positive without negatives gives no row.

    Rows without an id, a label or a vector, and vectors with null or non-finite components, take no part.  An id
    stands for one row: where it repeats, that of the smallest label, then vector, counts.  Of vectors of different
    length the shorter is filled up with zeros.  A label is any whole number.  Scores beyond 64 bits are an error.
    """
    asked = F.coalesce(F.expr(anchors), F.lit(False))
    kept = vectors.where(F.col(id).isNotNull() & F.col(label).isNotNull() & finite(vector))
    kept = kept.select(F.col(id).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), integers(vector, scale).alias("v"), asked.alias("anchor")).alias("row"))
    kept = stored(kept.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*"), "vectors")
    n, width = kept.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // block), min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST))
    rows = kept.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    queries = kept.where("anchor").select("id", "label", "v")

    near = _visit(rows, queries, blocks, width, lambda b, a: _positives(b, a, positives), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    queries = stored(queries.join(near, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "positives")

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = _visit(rows, queries, blocks, width, lambda b, a: _negatives(b, a, negatives, low, high), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
