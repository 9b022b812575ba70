"""As-of join: for each left row the last right row of its group at or before its time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of_join(left: DataFrame, right: DataFrame, *, by: list[str], on: str, width: int | None = None, suffix: str = "_right") -> DataFrame:
    """``left`` with the other columns of ``right``, null where no right row is early enough.

    Both sides have the columns ``by`` and ``on``, a timestamp.  Nulls in them match nothing: such right rows are left
    out, such left rows stay and get nulls.  Of right rows with one time the one that sorts last counts.  A right
    column whose name the left has too gets the ``suffix``.

    Nothing is paired up: each group is sorted once, with a running last value.  With ``width``, in seconds, a
    group is cut into stretches of time, each a task's work by itself, and gets the last right row before the
    stretch from a small table of one row a stretch; so a group with a long history is spread over tasks.
    """
    values = [c for c in right.columns if c not in (*by, on)]
    rest = [c for c in left.columns if c not in (*by, on)]
    new = {c: c + suffix if c in rest else c for c in values}
    known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in (*by, on)))
    struct = lambda names: F.struct(F.lit(1).alias("`_`"), *(F.col(f"`{c}`") for c in names))
    rows = left.select(*by, on, struct(rest).alias("_own"), F.lit(None).alias("_other"), F.lit(1).alias("_side"))
    others = right.where(known).select(*by, on, F.lit(None).alias("_own"), struct(values).alias("_other"), F.lit(0).alias("_side"))
    both = rows.unionByName(others)
    order = [F.col(on), F.col("_side"), F.col("_other")]
    if width is None:
        running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_other", F.last("_other", ignorenulls=True).over(running)).where("_side = 1")
    else:
        stretch = F.floor(F.unix_micros(F.col(on).cast("timestamp")) / F.lit(width * 1_000_000)).cast("long")
        both = both.withColumn("_stretch", stretch)
        running = Window.partitionBy(*by, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_other", F.last("_other", ignorenulls=True).over(running)).where("_side = 1")
        latest = F.max(F.when(F.col("_side") == 0, F.struct(F.col(on), F.col("_other"))))
        before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.where(known).groupBy(*by, "_stretch").agg(latest.alias("_latest"))
        carried = carried.withColumn("_before", F.last("_latest", ignorenulls=True).over(before)["_other"]).drop("_latest")
        found = found.join(carried, [*by, "_stretch"], "left").withColumn("_other", F.coalesce("_other", "_before"))
    own, other = F.col("_own"), F.col("_other")
    return found.select(*by, on, *(own[c].alias(c) for c in rest), *(other[c].alias(new[c]) for c in values))
