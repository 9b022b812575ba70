"""Tables that an operator writes between its steps, in the folder all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on a local master, as in tests, a new local folder is set.

    On a cluster a local folder would split tables over machines, so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``df`` as a table in ``buckets`` buckets by a column, so that reads grouped by it need no shuffle."""
    spark = df.sparkSession
    table = f"larkspur_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/larkspur/{table}"
    write = df.repartition(buckets, by).write.bucketBy(buckets, by).option("compression", "zstd")
    write.option("path", path).saveAsTable(table)
    _written.append(path)
    _tables.append(table)
    return spark.table(table)


def sweep(spark: SparkSession) -> int:
    """Delete the tables this session has written so far; call it when the results have been read."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    n, jvm = 0, spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
