"""Exact distinct counts that can be merged: bitmaps, made once and combined over any coarser grouping.

A count of distinct values of two groups can't be added up, but bitmaps of their values can be joined by OR.
A group has a bitmap of 4 KiB for each range of 32,768 whole numbers in which it has a value, so this suits values
that are dense, as keys that a sequence gives; scattered values take up to 4 KiB each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.shared import written


def distinct_bitmaps(df: DataFrame, *, by: list[str], value: str) -> DataFrame:
    """by, _bucket and _bits: the values of each group as bitmaps, written once; null values are left out.

    ``value`` is a whole number, negative ones too.  A group without a value has one row whose bitmap is empty.
    """
    v = F.col(f"`{value}`").cast("long")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(v))
    groups = [F.col(f"`{c}`") for c in by]
    return written(df.groupBy(*groups, F.bitmap_bucket_number(v).alias("_bucket")).agg(bits.alias("_bits")), "bitmaps")


def merged_counts(bitmaps: DataFrame, *, by: list[str], sets: list[list[str]], count: str = "n_distinct") -> DataFrame:
    """``by`` (null where a set leaves a column out), grouping_id as SQL numbers it, and the distinct values of each group of each set.

    Only the bitmaps are read.  A null in a column of ``by`` is a group like others, which grouping_id tells from a left-out one.
    """
    columns = [F.col(f"`{c}`") for c in by]
    each = [[F.col(f"`{c}`") for c in [*s, "_bucket"]] for s in sets]
    merged = bitmaps.groupingSets(each, *columns, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"), F.grouping_id().alias("_id"))
    # the bucket is in every set: its bit, the last, is 0
    again = merged.groupBy(*columns, F.shiftright("_id", 1).alias("grouping_id"))
    return again.agg(F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0)).cast("long").alias(count))
