"""Interval join: rows with a point in time that falls in another side's interval, group by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(spans: DataFrame, points: DataFrame, *, by: list[str], since: str, until: str, at: str, width: int) -> DataFrame:
    """Pairs with ``since <= at <= until`` and equal ``by``: all columns of both, ``by`` once.

    Time is cut into stretches of ``width`` seconds.  A span goes to each stretch that it touches, a point
    to its own, and the two meet in a hash join on group and stretch: a group with a long history is spread
    over many keys, and each pair is made once.  ``width`` should be near the usual length of a span; a span
    much longer than it is copied often.  Nulls in ``by`` or a time match nothing, nor does a span that
    ends before it starts.
    """
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width * 1_000_000)).cast("long")
    valid = spans.where(F.col(since) <= F.col(until))
    left = valid.withColumn("_stretch", F.explode(F.sequence(stretch(since), stretch(until))))
    right = points.where(F.col(at).isNotNull()).withColumn("_stretch", stretch(at))
    both = left.join(right, [*by, "_stretch"])
    return both.where(F.col(at).between(F.col(since), F.col(until))).drop("_stretch")
