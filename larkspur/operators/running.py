"""Running sums of any length, spread over tasks, and what they answer: inequality joins and sweeps over time.

A window over a whole group sorts that group in one task.  Here the points, each place of a group once, are
range-partitioned by group and place into bins of nearly equal size; the sums of whole bins are few, so a window over these
gives what lies before each bin, and a window inside each bin gives the rest.  As equal places are one point, no place
however frequent makes a bin large, and a group of any size is spread over bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.sources.shared import written


def _quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def running_sums(points: DataFrame, *, by: list[str], on: str, sums: list[str], bins: int | None = None) -> DataFrame:
    """``points`` with ``<column>_before`` for each of ``sums``: the sum over the points of the group with smaller ``on``.

    Points must be distinct in ``by`` and ``on`` and have no nulls there.  A sum over nothing, or over nulls only, is null.
    ``bins`` is the number of ranges, else as many as Spark makes shuffle partitions.
    """
    spark = points.sparkSession
    bins = bins or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that every later reader sees the same bins
    binned = written(points.repartitionByRange(bins, *_quoted([*by, on])).withColumn("_bin", F.spark_partition_id()), "binned")
    whole = binned.groupBy(*_quoted(by), "_bin").agg(*(F.sum(f"`{c}`").alias(f"_{c}") for c in sums))
    earlier = Window.partitionBy(*_quoted(by)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*_quoted(by), "_bin", *(F.sum(f"`_{c}`").over(earlier).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy(*_quoted(by), "_bin").orderBy(F.col(f"`{on}`")).rowsBetween(Window.unboundedPreceding, -1)
    within = binned.select("*", *(F.sum(f"`{c}`").over(inside).alias(f"{c}_within") for c in sums))
    both = within.join(before, [*by, "_bin"])
    total = lambda c: F.coalesce(F.col(f"`_{c}`") + F.col(f"`{c}_within`"), F.col(f"`_{c}`"), F.col(f"`{c}_within`"))
    return both.select(*_quoted(points.columns), *(total(c).alias(f"{c}_before") for c in sums))


def smaller_sums(left: DataFrame, right: DataFrame, *, by: list[str], on: str, value: str, bins: int | None = None) -> DataFrame:
    """``left`` with n_smaller and sum_smaller: the number of ``right``'s rows of the group with a smaller ``on``, and their sum of ``value``.

    That is the join on equal ``by`` and ``right.on < left.on``, aggregated by left row, without making its pairs: work
    grows with the rows of both sides, not with the pairs, and neither side needs to be small.  Nulls in ``by`` or ``on`` match nothing:
    such left rows have 0 and null, as have those with nothing smaller.  Null values count as rows and add
    nothing.  Repeated left rows each come back.
    """
    keys = [*by, on]
    known = left.select(*_quoted(keys)).na.drop().select("*", F.lit(None).cast("double").alias("_total"), F.lit(0).cast("long").alias("_rows"))
    counted = right.select(*_quoted(keys), F.col(f"`{value}`").cast("double").alias("_total")).na.drop(subset=keys).withColumn("_rows", F.lit(1).cast("long"))
    points = known.unionByName(counted).groupBy(*_quoted(keys)).agg(F.sum("_total").alias("_total"), F.sum("_rows").alias("_rows"))
    found = running_sums(points, by=by, on=on, sums=["_rows", "_total"], bins=bins)
    found = found.select(*_quoted(keys), F.col("_rows_before").alias("n_smaller"), F.col("_total_before").alias("sum_smaller"))
    rest = [c for c in left.columns if c not in ("n_smaller", "sum_smaller")]
    return left.select(*_quoted(rest)).join(found, keys, "left").select(*_quoted(rest), F.coalesce("n_smaller", F.lit(0)).cast("long").alias("n_smaller"), "sum_smaller")


def open_spans(spans: DataFrame, *, by: list[str], since: str, until: str, bins: int | None = None) -> DataFrame:
    """by, at and n_open: how many spans are open from each time ``at`` on at which their number changes or a span begins or ends.

    A span is open from ``since`` on and until ``until``, this moment left out.  Spans that are empty, end before they
    begin or have a null are left out.
    """
    valid = spans.where(F.col(f"`{since}`") < F.col(f"`{until}`")).na.drop(subset=[*by, since, until])
    begin = valid.select(*_quoted(by), F.col(f"`{since}`").alias("at"), F.lit(1).alias("_step"))
    end = valid.select(*_quoted(by), F.col(f"`{until}`").alias("at"), F.lit(-1).alias("_step"))
    steps = begin.unionByName(end).groupBy(*_quoted(by), "at").agg(F.sum("_step").alias("_step"))
    running = running_sums(steps, by=by, on="at", sums=["_step"], bins=bins)
    return running.select(*_quoted(by), "at", (F.coalesce("_step_before", F.lit(0)) + F.col("_step")).alias("n_open"), "_step")


def merged_spans(spans: DataFrame, *, by: list[str], since: str, until: str, bins: int | None = None) -> DataFrame:
    """by, since and until of the times at which one span or more is open, each as long as can be; spans that touch are one."""
    steps = open_spans(spans, by=by, since=since, until=until, bins=bins)
    # a stretch begins where nothing was open before, and ends where nothing is open any more
    begins = (F.col("n_open") > 0) & (F.col("n_open") == F.col("_step"))
    edges = steps.where(begins | (F.col("n_open") == 0) & (F.col("_step") != 0))
    edges = edges.select(*_quoted(by), "at", F.when(begins, 1).otherwise(0).alias("_begins"))
    numbered = running_sums(edges, by=by, on="at", sums=["_begins"], bins=bins)
    number = F.coalesce("_begins_before", F.lit(0)) + F.col("_begins")
    whole = numbered.groupBy(*_quoted(by), number.alias("_number")).agg(F.min("at").alias(since), F.max("at").alias(until))
    return whole.drop("_number")
