"""Running a stream over what its source holds, and reading what it has written."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from larkspur.sources.shared import delete_path, shared_folder

_written: list[str] = []
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def delete_streams(spark: SparkSession) -> int:
    """Delete what streams of this session have written; call it when their results have been read."""
    n = 0
    while _written:
        n += delete_path(spark, _written.pop())
    return n


def stream_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's input, output and progress, in the folder that all machines share."""
    path = f"{shared_folder(spark)}/larkspur-streams/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB: on the executors' disks, with changes logged at each batch."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def event_stream(spark: SparkSession, folder: str, *, batch_bytes: int = 64 << 30) -> DataFrame:
    """The events table as a file stream; ``ts`` is a zoned timestamp there, as watermarks need it.

    A batch takes files of ``batch_bytes`` at most, and one file at least, in order of their change; a table of more bytes should
    be in order of time, as rows behind the watermark are left out.
    """
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a file or a folder of files
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{folder}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """What ``stream`` appends until its source is exhausted, written as Parquet and read again.

    Output and the stream's own checkpoint go to ``spark.checkpoint.dir``, the folder that all machines
    share; where it is unset on a local master, as in tests, a new local folder is taken.  On a cluster that is an
    error.  A stream that fails raises.  ``delete_streams`` removes what has been written.
    """
    spark = stream.sparkSession
    path = stream_path(spark, name)
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
    run.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_in_batches(batches: Iterable[DataFrame], start: Callable[[DataFrame], DataStreamWriter], path: str) -> list[dict]:
    """Runs a stream that gets ``batches`` one after the other; the last progress that each reports.

    Each batch is added to the files that the stream reads, then the stream goes on from its checkpoint until it has read
    them all.  So what came before, and where the watermark is, doesn't depend on how fast anything runs.
    ``start`` makes the writer of the stream from its rows.  Batches have one schema.
    """
    progress = []
    for batch in batches:
        batch.write.mode("append").parquet(f"{path}/in")
        rows = batch.sparkSession.readStream.schema(batch.schema).parquet(f"{path}/in")
        run = start(rows).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
        progress.append(run.lastProgress)
    return progress


def finished_in_batches(batches: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, list[dict]]:
    """What the stream that ``build`` makes appends over ``batches``, read again, and its progress after each."""
    spark = batches[0].sparkSession
    path, schemas = stream_path(spark, name), []

    def start(rows: DataFrame) -> DataStreamWriter:
        out = build(rows)
        schemas.append(out.schema)
        return out.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")

    progress = run_in_batches(batches, start, path)
    return spark.read.schema(schemas[0]).parquet(f"{path}/out"), progress
