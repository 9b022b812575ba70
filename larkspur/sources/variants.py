"""Semi-structured values: JSON text as VARIANT, typed columns cut out of it by path, and its entries as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shredded(df: DataFrame, column: str, paths: dict[str, tuple[str, str]], *, as_variant: str = "parsed") -> DataFrame:
    """``df`` with ``as_variant``, the JSON text of ``column`` parsed once, and a typed column for each of ``paths`` (name: path, type).

    Text that is no JSON gives a null variant and null columns, and the row stays, its text unchanged.  A value that is missing
    or doesn't fit its type is null.  Written as Parquet, the typed columns are pruned and filtered as any others, without parsing.
    """
    parsed = df.withColumn(as_variant, F.try_parse_json(F.col(f"`{column}`")))
    typed = {name: F.try_variant_get(F.col(f"`{as_variant}`"), path, kind) for name, (path, kind) in paths.items()}
    return parsed.withColumns(typed)


def entries(df: DataFrame, column: str) -> DataFrame:
    """A row for each entry of the variant ``column``: of an object with ``key``, of an array with ``pos``; ``value`` is a variant.

    Null variants, empty ones and plain values have no entries and give no row.
    """
    spark = df.sparkSession
    each = spark.tvf.variant_explode(F.col(f"`{column}`").outer())
    return df.lateralJoin(each)
