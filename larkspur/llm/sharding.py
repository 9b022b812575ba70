"""Shards by minimax contiguous partition.

Rows of equal text are one atomic group; groups stand in the order of their texts' hashes.  The
smallest capacity with which ``shards`` contiguous runs hold all groups is found by binary search,
each try checked greedily, and the groups are cut under it: no contiguous partition in this order has a
smaller largest shard.  Where that leaves a choice, a run ends as near as it can to an even share of what is
still to place, so one large group doesn't leave other shards empty.

The driver never holds the groups.  It sees running sums of sizes at some group ends: at first those of large
groups and else about POINTS, evenly spread.  Between two of these it knows nothing but that groups there are
small, so a try is checked twice, as if a cut could be nowhere there and as if it could be anywhere.  That bounds
the capacity from above and below; only the spans in which a cut can lie, one for each at most, are then looked at more finely,
until the bounds meet.  Cuts are keys, so each row finds its shard without a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sql import text_of
from ._store import stored

POINTS = 1 << 16
_KEY = ("h", "c", "n")


def running_sum(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``df`` with ``until``, the sum of ``value`` up to the row in the given order, as a stored table.

    Rows are range-partitioned and summed within their partition; the driver adds up one number a partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = total + np.cumsum(batch.column(value).to_numpy().astype(np.int64))
            total = int(sums[-1]) if len(sums) else total
            columns = [*batch.columns, pa.array(np.full(len(sums), part, np.int32)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    sums = stored(ranged.mapInArrow(run, f"{schema}, part int, local long"), "running")
    parts = sorted(sums.groupBy("part").agg(F.max("local").alias("sum")).collect())
    starts, at = [], 0
    for p in parts:
        starts.append((p["part"], at))
        at += p["sum"]
    offsets = df.sparkSession.createDataFrame(starts, "part int, before long")
    return sums.join(F.broadcast(offsets), "part").withColumn("until", F.col("local") + F.col("before")).drop("part", "local", "before")


class _Ends:
    """Running sums at the group ends that are known.

    ``grain`` says for the gap after each how large the groups in it can be: less than so many bytes, or 0 if the
    gap is one group.
    """

    def __init__(self, total: int) -> None:
        self.at, self.grain = np.array([0, total], np.int64), np.array([total + 1, 0])

    def look(self, spans: list[tuple[int, int]], step: int, found: np.ndarray, closed: np.ndarray) -> None:
        """Take in the ends ``found`` in the spans; all groups of ``step`` bytes or more there end at ``closed`` ones."""
        at = np.unique(np.concatenate([found, self.at]))
        grain = self.grain[np.searchsorted(self.at, at, side="right") - 1]
        for a, b in spans:
            inside = slice(int(np.searchsorted(at, a)), int(np.searchsorted(at, b)))
            grain[inside] = np.where(np.isin(at[inside.start + 1 : inside.stop + 1], closed), 0, np.minimum(grain[inside], step))
        self.at, self.grain = at, grain

    def greedy(self, capacity: int, shards: int) -> tuple[bool, list[int]]:
        """Whether ``shards`` runs of that capacity, cut at known ends, reach the end, and where they end."""
        ends, at, total = [], 0, int(self.at[-1])
        for _ in range(shards):
            if at + capacity >= total:
                return True, [*ends, total]
            at = int(self.at[np.searchsorted(self.at, at + capacity, side="right") - 1])
            ends.append(at)
        return False, ends

    def bounds(self, low: int, high: int, shards: int) -> tuple[bool, list[int], list[int]]:
        """Whether runs of capacity ``high`` could reach the end, and between which places runs of ``low`` to ``high`` end."""
        total, lower, upper = int(self.at[-1]), [0], [0]
        for _ in range(shards):
            first, last = min(lower[-1] + low, total), min(upper[-1] + high, total)
            k, j = (int(np.searchsorted(self.at, x, side="right")) - 1 for x in (first, last))
            lower.append(max(int(self.at[k]), first - int(self.grain[k]) if self.grain[k] else 0))
            upper.append(last if self.grain[j] else int(self.at[j]))
        return upper[-1] >= total, lower[1:], upper[1:]

    def least(self, low: int, high: int, shards: int, *, anywhere: bool) -> int:
        """The least capacity that suffices, if cuts are at known ends or, with ``anywhere``, also where one may be."""
        fits = (lambda c: self.bounds(c, c, shards)[0]) if anywhere else (lambda c: self.greedy(c, shards)[0])
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if fits(middle) else (middle + 1, high)
        return low

    def _share(self, at: int, shards: int) -> float:
        """An even share of what comes after ``at``, but for groups that are larger than it and take a shard each."""
        first = int(np.searchsorted(self.at, at))
        size, left = np.diff(self.at[first:])[self.grain[first:-1] == 0], float(self.at[-1] - at)
        share = left / shards
        while True:
            large = size[size > share]
            if len(large) >= shards or share == (new := (left - large.sum()) / (shards - len(large))):
                return share
            share = new

    def even(self, capacity: int, shards: int) -> list[int]:
        """Ends of at most ``shards`` runs of a capacity that suffices, as even as the known ends allow.

        A run must end late enough for the rest to fit: not before where runs filled from the end backwards
        would begin, or else where runs filled from the beginning end.
        """
        total, at, ends = int(self.at[-1]), 0, []
        latest = self.greedy(capacity, shards)[1]
        latest += [total] * (shards - len(latest))
        begins = [total]
        for _ in range(shards - 1):
            begins.append(int(self.at[np.searchsorted(self.at, begins[-1] - capacity, side="left")]))
        for k, (last, begin) in enumerate(zip(latest, reversed(begins), strict=True)):
            most = min(at + capacity, last)
            if begin > most:
                at = last  # only the runs filled from the beginning are known to fit
            else:
                low = int(np.searchsorted(self.at, begin, side="left"))
                low = max(low, int(np.searchsorted(self.at, at, side="right")))
                some = self.at[low : int(np.searchsorted(self.at, most, side="right"))]
                goal = at + self._share(at, shards - k)
                at = int(some[np.abs(some - goal).argmin()]) if len(some) else max(at, begin)
            ends.append(at)
        return ends


def _spans(ends: _Ends, lower: list[int], upper: list[int]) -> list[tuple[int, int]]:
    """Spans of the running sum, from one known end to another, that hold all places from ``lower`` to ``upper``."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(lower, upper, strict=True)):
        i = int(np.searchsorted(ends.at, a, side="right")) - 1
        j = min(int(np.searchsorted(ends.at, b, side="left")) + 1, len(ends.at) - 1)
        if not ends.grain[i:j].any():
            continue
        lo, hi = int(ends.at[i]), int(ends.at[j])
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return spans


def _any(conditions: list[Column]) -> Column:
    """Whether one of the conditions holds, as a balanced tree."""
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:]) if half else conditions[0]


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Ends of the runs, as values of ``until``, of a minimax partition of ``groups`` (size, until)."""
    ends, low, high = _Ends(total), max(largest, -(-total // shards)), total
    spans = [(0, total)]
    while True:
        # a cut is unsure by a few cells for each run before it: with so many cells each round gets on
        step = max(1, sum(b - a for a, b in spans) // max(POINTS, 8 * shards**2))
        inside = _any([(F.col("until") > a) & (F.col("until") <= b) for a, b in spans])
        large = F.collect_list(F.when(F.col("size") >= step, F.struct("until", "size"))).alias("large")
        cells = groups.where(inside).groupBy(F.expr(f"until div {step}L"))
        rows = cells.agg(F.max("until").alias("u"), F.count("*").alias("n"), large).collect()
        known = [r["u"] for r in rows] + [x for r in rows for g in r["large"] for x in (g["until"] - g["size"], g["until"])]
        closed = [r["u"] for r in rows if r["n"] == 1] + [g["until"] for r in rows for g in r["large"]]
        ends.look(spans, step, np.array(known, np.int64), np.array(closed, np.int64))
        high = ends.least(low, high, shards, anywhere=False)
        low = ends.least(low, high, shards, anywhere=True)
        if low == high:
            return ends.even(high, shards)
        # a run of the best partition ends between where runs of these two can
        spans = _spans(ends, *ends.bounds(low, high, shards)[1:])


def shard(docs: DataFrame, shards: int = 40, *, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs``.

    Size is the text's UTF-8 bytes and ``overhead``; a null text counts as an empty one.  Rows of equal
    text, whatever else they hold, share a shard: texts are equal here if their 64-bit hash, CRC-32
    and length are; a very long text is a large group like others.  ``slot`` counts a shard's rows from 0, in the order of text hash and doc_id (nulls
    first); rows equal in both stand in any order.  With fewer groups than shards the last shards are empty.
    Other columns of ``docs`` are not looked at; an empty table has no shards.
    """
    text = text_of()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("c"),
        F.xxhash64(text).alias("h"),
        F.octet_length(text).alias("n"),
    )
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "rows")
    groups = running_sum(rows.groupBy(*_KEY).agg(F.sum("size").alias("size")), [*_KEY], "size")
    total, largest = groups.agg(F.max("until"), F.max("size")).first()
    ends = minimax_cuts(groups, total, largest, shards) if total else []
    keys = groups.where(F.col("until").isin(ends[:-1])).select(*_KEY, "until").collect() if len(ends) > 1 else []
    own, at = F.struct(*_KEY), F.lit(0)
    for k in keys:
        cut = F.struct(*(F.lit(k[c]).cast(t) for c, t in zip(_KEY, ("long", "long", "int"), strict=True)))
        at = at + (own > cut).cast("int")
    rows = rows.withColumn("shard", at).withColumn("one", F.lit(1))
    placed = running_sum(rows, ["shard", *_KEY, "doc_id", "tie"], "one")
    before, starts = 0, []
    for r in sorted(placed.groupBy("shard").count().collect()):
        starts.append((r["shard"], before))
        before += r["count"]
    first = docs.sparkSession.createDataFrame(starts, "shard int, first long")
    slot = F.col("until") - 1 - F.col("first")
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        F.col("c").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
