"""Partitioned writes, and reads of text formats that keep the records that don't fit the schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_BAD = "_bad_record"


def write_partitioned(df: DataFrame, path: str, *, by: list[str], fmt: str = "parquet", spread: int = 8, mode: str = "errorifexists") -> None:
    """``df`` in folders by the values of ``by``, at most ``spread`` files a folder.

    Rows are dealt by value and a number of 0 to ``spread`` - 1, so a value that holds most rows is written by
    several tasks, and a task doesn't open a file in every folder.  The number comes from the row's own columns
    and not from chance, so a task that runs again writes the same rows.
    """
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(spread))
    dealt = df.withColumn("_salt", salt).repartition(*by, "_salt").drop("_salt")
    dealt.write.partitionBy(*by).mode(mode).format(fmt).save(path)


def read_checked(spark: SparkSession, path: str, schema: StructType, *, fmt: str, by: Sequence[str] = (), **options: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of CSV or JSON files: rows of the schema, and the source text of records that don't fit it.

    Nothing stops at a broken record and none is lost.  The schema is given, so no pass infers it.  ``by`` are the
    columns that the folders' names give: filters on these prune folders.  All others are parsed whatever a query needs,
    as a value that isn't parsed can't be found broken.
    """
    wide = StructType([*schema.fields]).add(_BAD, StringType())
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).options(**options).format(fmt).load(path)
    parsed = [f.name for f in schema.fields if f.name not in by] + [_BAD]
    # out of a generator, whose columns Spark neither prunes nor filters below
    read = read.select(*(F.col(f"`{c}`") for c in by), F.stack(F.lit(1), *(F.col(f"`{c}`") for c in parsed)).alias(*parsed))
    own = [F.col(f"`{f.name}`") for f in schema.fields]
    return read.where(F.col(_BAD).isNull()).select(*own), read.where(F.col(_BAD).isNotNull()).select(F.col(_BAD).alias("record"), *own)
