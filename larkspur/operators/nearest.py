"""Exact nearest neighbours by an inverted file whose cells are skipped by the triangle inequality.

The index puts every vector into the cell of its nearest centre and keeps its distance r from there.  A cell is cut
into rings by r, and a ring of many rows into blocks of a bounded size.  A query at distance d from the centre is
at least ``max(d - outer, inner - d)`` away from all that a ring holds.

A search has two steps.  First each query looks at the rings with the least bounds until they have enough rows; the
last of the k best so far limits what can still count.  Then it looks at all other rings whose bound isn't beyond that limit.
No neighbour is missed, whatever the centres; good ones only make the share of rings that are skipped larger.

Centres come from a bounded sample of the vectors, but every vector is indexed.  The driver holds the centres and one row
a ring.  A task holds one block and lets the queries that visit it stream past.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.sources.shared import written

SAMPLE = 8192  # vectors that the centres are found on
CELLS, RINGS = 128, 16  # centres, and rings a cell, at most
BLOCK = 32_768  # rows a block at most, nearly
LOT = 128  # queries looked at together
VISITS = 4096  # visits that leave a task together: each has a copy of its query's vector
MARGIN = 1e-5  # by which a bound must be beyond a limit, far more than doubles err


def _finite(vector: str) -> Column:
    inside = lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf"))  # noqa: E731  Spark sorts NaN above infinity
    return F.col(vector).isNotNull() & F.forall(vector, inside)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` doubles as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0)


def _centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Means of ``cells`` clusters of the sample, started at evenly spaced rows; an empty cluster stays where it was."""
    centres = sample[:: max(1, len(sample) // max(1, cells))][:cells].copy()
    for _ in range(rounds if len(sample) else 0):
        own = _squares(sample, centres).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


@dataclass(frozen=True)
class Rings:
    """The centres, and one entry a ring in the other arrays: cell, least and largest r, rows, its first block and their number."""

    width: int
    centres: np.ndarray
    cell: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    size: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """Queries x rings: no row of a ring is nearer than this."""
        d = np.sqrt(_squares(v, self.centres))[:, self.cell]
        return np.maximum(np.maximum(d - self.outer, self.inner - d), 0) - MARGIN

    def first_rings(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Queries x rings: those with the least bounds that together have k rows."""
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out


@dataclass(frozen=True)
class Index:
    """``rows``: id, v, block, of every vector; ``rings``: what the driver and the tasks know of all of them."""

    rows: DataFrame
    rings: Rings


def build_index(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", cells: int = CELLS, rings: int = RINGS, block: int = BLOCK) -> Index:
    """The index of the rows of ``vectors`` that have an id and a vector of finite numbers; other rows are left out.

    All vectors must have one length, else an error says so.  Repeated ids and vectors are rows like others; a vector
    that very many rows have fills one ring, which is cut into blocks by the ids.
    """
    spark = vectors.sparkSession
    kept = vectors.where(F.col(id).isNotNull() & _finite(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n, width, shortest = kept.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.min(F.size("v")), F.lit(0))).first()
    if width != shortest:
        raise ValueError(f"vectors of {shortest} to {width} components")
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    centres = _centres(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), width), min(cells, max(1, int(n**0.5))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = _squares(_matrix(b["v"], width), centres)
            cell = away.argmin(1)
            yield pa.record_batch([b["id"], b["v"], pa.array(cell.astype(np.int32)), pa.array(np.sqrt(away[np.arange(len(cell)), cell]))], ["id", "v", "cell", "r"])

    placed = written(kept.mapInArrow(place, "id long, v array<double>, cell int, r double"), "placed")
    shares = [k / rings for k in range(1, rings)]
    cuts = placed.groupBy("cell").agg(F.percentile_approx("r", shares, 10_000).alias("cuts")) if shares else placed.select("cell", F.array().cast("array<double>").alias("cuts")).distinct()
    edges = {r["cell"]: sorted(set(r["cuts"])) for r in cuts.collect()}  # a row a cell
    edge_of = spark.createDataFrame(list(edges.items()), "cell int, edges array<double>")
    ringed = placed.join(F.broadcast(edge_of), "cell").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("r"))))
    found = ringed.groupBy("cell", "ring").agg(F.min("r").alias("inner"), F.max("r").alias("outer"), F.count("*").alias("n")).sort("cell", "ring").collect()
    blocks = np.array([max(1, -(-r["n"] // block)) for r in found], np.int64)
    first = np.cumsum(blocks) - blocks
    starts = spark.createDataFrame([(r["cell"], r["ring"], int(a), int(b)) for r, a, b in zip(found, first, blocks, strict=True)], "cell int, ring int, first int, blocks int")
    dealt = ringed.join(F.broadcast(starts), ["cell", "ring"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    column = lambda name, kind: np.array([r[name] for r in found], kind)
    known = Rings(width, centres, column("cell", np.int64), column("inner", np.float64), column("outer", np.float64), column("n", np.int64), first, blocks)
    return Index(dealt.select("id", "v", "block"), known)


def _visits(queries: DataFrame, rings: Rings, k: int, further: bool) -> DataFrame:
    """(query_id, v, own, block, limit) of each block that a query looks at; in the further step, beyond the first, ``limit`` counts."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                b = batch.slice(at, LOT)
                bounds = rings.bounds(_matrix(b["v"], rings.width))
                chosen = rings.first_rings(bounds, k)
                if further:
                    chosen = ~chosen & (bounds <= b["limit"].to_numpy()[:, None])
                q, ring = np.nonzero(chosen)
                copies = rings.blocks[ring]
                q, start = np.repeat(q, copies), np.repeat(rings.first[ring], copies)
                block = start + np.arange(len(start)) - np.repeat(np.cumsum(copies) - copies, copies)
                for cut in range(0, len(q), VISITS):
                    some = pa.array(q[cut : cut + VISITS])
                    yield pa.record_batch([*(b[c].take(some) for c in ("query_id", "v", "limit")), pa.array(block[cut : cut + VISITS].astype(np.int32))], ["query_id", "v", "limit", "block"])

    return queries.mapInArrow(plan, "query_id long, v array<double>, limit double, block int")


def _visit(visits: DataFrame, index: Index, k: int, digits: int, skip_own: bool) -> DataFrame:
    """(query_id, id, distance, compared) of the k best rows that each visit finds; ``compared``, on a visit's first row: rows looked at."""
    spark, width, rings = visits.sparkSession, index.rings.width, index.rings
    blocks = int(rings.blocks.sum())
    # small blocks share a task, which takes one after the other
    tasks = max(1, min(blocks, max(int(rings.size.sum()) // BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    rows = index.rows.select(F.lit(0).alias("side"), "block", "id", "v")
    both = rows.unionByName(visits.select(F.lit(1).alias("side"), "block", F.col("query_id").alias("id"), "v"))
    dealt = both.repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block", "side", "id")

    def best(ids: np.ndarray, vectors: np.ndarray, query: int, v: np.ndarray) -> tuple[np.ndarray, ...]:
        away = np.round(((vectors - v) ** 2).sum(1), digits)
        order = np.arange(len(away)) if len(away) <= k + 1 else np.flatnonzero(away <= np.partition(away, k)[k])
        order = order[np.lexsort((ids[order], away[order]))]
        order = order[ids[order] != query][:k] if skip_own else order[:k]
        compared = np.zeros(len(order), np.int64)
        compared[:1] = len(away)
        return np.full(len(order), query), ids[order], away[order], compared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_ids, held = -1, [np.zeros(0, np.int64)], [np.zeros((0, width))]
        for b in batches:
            block, side, ids, out = b["block"].to_numpy(), b["side"].to_numpy(), b["id"].to_numpy(), []
            cuts = np.flatnonzero(np.diff(block * 2 + side, prepend=-1, append=-1)).tolist()
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if block[at] != now:
                    now, held_ids, held = block[at], [np.zeros(0, np.int64)], [np.zeros((0, width))]
                part = _matrix(b["v"].slice(at, end - at), width)
                if side[at] == 0:
                    held_ids.append(ids[at:end])
                    held.append(part)
                    continue
                held_ids, held = [np.concatenate(held_ids)], [np.concatenate(held)]
                out += [best(held_ids[0], held[0], q, v) for q, v in zip(ids[at:end].tolist(), part, strict=True)]
            if out:
                yield pa.record_batch([np.concatenate(c) for c in zip(*out, strict=True)], ["query_id", "id", "distance", "compared"])

    return dealt.mapInArrow(run, "query_id long, id long, distance double, compared long")


def nearest(queries: DataFrame, index: Index, *, id: str = "vec_id", vector: str = "embedding", k: int = 5, digits: int = 6, skip_own: bool = True) -> DataFrame:
    """query_id, rank, id, distance (squared, rounded to ``digits``) and compared, the rows that the query was compared with.

    The k nearest rows of the index, ranked from 1; of equal distances the smaller id comes first.  With ``skip_own``
    rows of the query's own id don't count.  A query without an id or a vector of finite numbers gives no row; a
    query id stands for one vector, of several for the first in order.  A query of another length than the index's vectors is an error.
    """
    if not len(index.rings.size):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double, compared long")
    asked = queries.where(F.col(id).isNotNull() & _finite(vector)).select(F.col(id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.groupBy("query_id").agg(F.min("v").alias("v"))
    enough = k + 1 if skip_own else k
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    start = _visit(_visits(asked.withColumn("limit", F.lit(float("inf"))), index.rings, enough, False), index, k, digits, skip_own)
    start = written(start, "first-visits")
    ranked = start.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # what a rounded distance may stand for, as a distance that isn't squared
    limits = ranked.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance") + 10.0**-digits)).otherwise(float("inf")).alias("limit"))
    more = _visit(_visits(asked.join(limits, "query_id", "left").fillna(float("inf"), ["limit"]), index.rings, enough, True), index, k, digits, skip_own)
    found = start.unionByName(more).withColumn("compared", F.sum("compared").over(Window.partitionBy("query_id")))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance", "compared")
