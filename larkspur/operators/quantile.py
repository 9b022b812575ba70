"""Exact quantiles of a whole column, without its values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, column: str, shares: list[float], *, cells: int = 4096, few: int = 10_000) -> list[float | None]:
    """The interpolated quantiles of ``column``, a number; nulls, NaN and infinities are left out.  None where no value is left.

    Each wanted rank is closed in on: a pass counts the values in ``cells`` equal cells of the range still
    possible, and goes on in the one that holds the rank, until ``few`` values or one are left.  What
    reaches the driver is bounded by these two numbers.
    """
    value = F.col(f"`{column}`").cast("double")
    values = df.select(value.alias("v")).where((F.col("v") > float("-inf")) & (F.col("v") < float("inf")))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()

    def at(rank: int, lo: float, hi: float) -> float:
        below = 0
        while lo < hi:
            inside = values.where(F.col("v").between(lo, hi))
            part = 1.0 if math.isfinite(hi - lo) else 0.5  # so that the width is a finite number
            place = (F.col("v") * part - lo * part) / F.lit(hi * part - lo * part)
            cell = F.least(F.floor(place * cells), F.lit(cells - 1))
            counted = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            for r in sorted(counted.collect()):
                if rank < below + r["k"]:
                    lo, hi, size = r["lo"], r["hi"], r["k"]
                    break
                below += r["k"]
            if lo < hi and size <= few:
                return values.where(F.col("v").between(lo, hi)).sort("v").limit(few).collect()[rank - below]["v"]
        return lo

    out: list[float | None] = []
    for share in shares:
        place = share * (n - 1)
        first = math.floor(place)
        if not n:
            out.append(None)
            continue
        a = at(first, low, high)
        b = at(first + 1, low, high) if place > first else a
        out.append(a + (b - a) * (place - first))
    return out
