"""A data source of Arrow files with the least and largest values of their columns, written whole or not at all.

Each task writes files of its own; the commit puts their names, sizes and value ranges into one manifest, under its name only
when it is whole.  Readers know no file but those of the manifest, so what failed tasks leave is never read, and an abort
deletes it.  Filters reach the reader: files whose ranges can't match aren't opened, each other one is a partition.

    spark.dataSource.register(ArrowFiles)
    df.write.format("arrow_files").mode("append").save(path)
    read_arrow_files(spark, path).where("event_id < 100")

``path`` is one that pyarrow knows (a local or mounted folder, file://, hdfs://, s3://).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
FILE_ROWS = 100_000


def _plain(value):  # noqa: ANN001, ANN202
    """A value that JSON can hold and that sorts as the value does; None for one that can't be compared so."""
    if isinstance(value, dt.datetime):
        whole = value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value
        return (whole - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    if isinstance(value, dt.date):
        return value.toordinal()
    return value if isinstance(value, int | float | str) and not isinstance(value, bool) else None


def _ranges(table: pa.Table) -> dict[str, list]:
    """Least and largest value of each column that has an order; an empty list for one of nulls only; none where NaN stands."""
    out: dict[str, list] = {}
    for name, column in zip(table.column_names, table.columns, strict=True):
        kind = column.type
        if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
            continue  # Spark sorts NaN above all numbers
        if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_temporal(kind):
            ends = [_plain(pc.min_max(column)[k].as_py()) for k in ("min", "max")]
            if column.null_count == len(column):
                out[name] = []
            elif None not in ends:
                out[name] = ends
    return out


def _can_match(filter_: Filter, ranges: dict[str, list]) -> bool:
    """False if no value in the ranges satisfies the filter."""
    if len(filter_.attribute) != 1 or filter_.attribute[0] not in ranges:
        return True
    ends = ranges[filter_.attribute[0]]
    if not ends:
        return False
    least, largest = ends
    values = [_plain(v) for v in (filter_.value if isinstance(filter_, In) else [filter_.value]) if v is not None]
    if None in values or any(isinstance(v, str) != isinstance(least, str) for v in values):
        return True
    if isinstance(filter_, EqualTo | In):
        return any(least <= v <= largest for v in values)
    v = values[0] if values else None
    if v is None:
        return True
    return {GreaterThan: largest > v, GreaterThanOrEqual: largest >= v, LessThan: least < v, LessThanOrEqual: least <= v}[type(filter_)]


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_manifest(path: str) -> dict:
    """{"schema": ..., "files": [{"name", "rows", "ranges"}]}"""
    files, folder = _folder(path)
    with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _File(InputPartition):
    name: str

    def __post_init__(self) -> None:
        super().__init__(self.name)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes note of comparisons; Spark checks every row all the same, as a file that can match has others too."""
        self.filters = [f for f in filters if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)]
        return filters

    def partitions(self) -> list[InputPartition]:
        return [_File(f["name"]) for f in read_manifest(self.path)["files"] if all(_can_match(x, f["ranges"]) for x in self.filters)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):  # Spark asks for one partition where there is none
            return
        files, folder = _folder(self.path)
        with files.open_input_file(f"{folder}/{partition.name}") as f:
            reader = pa.ipc.open_file(f)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k)


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, rows: int) -> None:
        self.path, self.schema, self.overwrite, self.rows = path, schema.json(), overwrite, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = _folder(self.path)
        files.create_dir(folder, recursive=True)
        done: list[dict] = []

        def put(table: pa.Table) -> None:
            name = f"part-{uuid.uuid4().hex}.arrow"
            with files.open_output_stream(f"{folder}/{name}") as f, pa.ipc.new_file(f, table.schema) as out:
                out.write_table(table)
            done.append({"name": name, "rows": table.num_rows, "ranges": _ranges(table)})

        held: list[pa.RecordBatch] = []
        for batch in iterator:
            for at in range(0, batch.num_rows, self.rows):
                held.append(batch.slice(at, self.rows))
                if sum(map(len, held)) >= self.rows:
                    put(pa.Table.from_batches(held))
                    held = []
        if held:
            put(pa.Table.from_batches(held))
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _folder(self.path)
        files.create_dir(folder, recursive=True)
        there = files.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound
        before = read_manifest(self.path)["files"] if there else []
        new = [f for m in messages if m is not None for f in m.files]
        if there and not self.overwrite and read_manifest(self.path)["schema"] != self.schema:
            self.abort(messages)
            raise ValueError("rows of another schema than the table's")
        part = f"{folder}/_{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(json.dumps({"schema": self.schema, "files": new if self.overwrite else before + new}).encode())
        files.move(part, f"{folder}/{MANIFEST}")
        for f in before if self.overwrite else ():
            files.delete_file(f"{folder}/{f['name']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _folder(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            files.delete_file(f"{folder}/{f['name']}")


class ArrowFiles(DataSource):
    """Options: ``path``, and for writes ``fileRows``, the rows of a file at most."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(read_manifest(self.options["path"])["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("fileRows", FILE_ROWS)))


def read_arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; from now on this session hands filters to data sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").load(path)


def write_arrow_files(df: DataFrame, path: str, *, mode: str = "append", file_rows: int = FILE_ROWS) -> None:
    """``mode`` is append or overwrite.  Sort or range-partition ``df`` by what will be filtered on: then ranges tell files apart."""
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format("arrow_files").option("fileRows", file_rows).mode(mode).save(path)
