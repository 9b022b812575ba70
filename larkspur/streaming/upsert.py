"""A table of the newest row of each key that a stream keeps up to date, each batch exactly once.

Keys are dealt into buckets by hash.  A batch rewrites only the buckets that it touches, into a folder of its own number, and
then commits: one small file says for every bucket which batch wrote it last.  Readers see committed buckets only.  A batch that
is killed before its commit leaves files that nobody reads, and runs again from the table as it was before;
one that comes again after its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class UpsertTable:
    """``path`` in a file system with an atomic rename; of rows with one key (``keys``) that which is largest in ``order`` stays."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: list[str]
    order: list[str]
    buckets: int = 16

    def _files(self, path: str):  # noqa: ANN202
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> tuple[int, dict[int, int]]:
        """The number of the last committed batch (-1: none), and the batch that wrote each bucket last."""
        folder, files = self._files(f"{self.path}/commits")
        if not files.exists(folder):
            return -1, {}
        last = max((int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()), default=-1)
        if last < 0:
            return -1, {}
        said = self.spark.read.text(f"{self.path}/commits/{last}", wholetext=True).first()[0]
        return last, {int(k): v for k, v in json.loads(said).items()}

    def _commit(self, batch_id: int, versions: dict[int, int]) -> None:
        """All of the file or nothing: it gets its name when it is whole."""
        part, files = self._files(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = files.create(part)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        if not files.rename(part, self._files(f"{self.path}/commits/{batch_id}")[0]):
            raise RuntimeError(f"batch {batch_id} has been committed by another run")

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}/_bucket={b}" for b, v in sorted(versions.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The table after the last committed batch."""
        return self._read(self.committed()[1])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in a batch; for ``foreachBatch``.  Numbers grow from batch to batch.

        Rows with a null in a key or in the order are left out.  Rows equal in key and order: the largest by all columns stays.
        """
        last, versions = self.committed()
        if batch_id <= last:
            return
        quoted = lambda names: [F.col(f"`{c}`") for c in names]
        known = reduce(lambda a, b: a & b, (c.isNotNull() for c in quoted([*self.keys, *self.order])))
        bucket = F.pmod(F.xxhash64(*quoted(self.keys)), F.lit(self.buckets)).cast("int")
        newest = F.max(F.struct(*(F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(self.order)), F.struct(*quoted(self.schema.names)).alias("row")))
        best = lambda df: df.groupBy(bucket.alias("_bucket"), *quoted(self.keys)).agg(newest.alias("_n")).select("_bucket", "_n.row.*")
        new = best(batch.where(known)).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            old = self._read({b: v for b, v in versions.items() if b in touched})
            merged = best(new.select(self.schema.names).unionByName(old))
            merged.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows/batch={batch_id}")
            self._commit(batch_id, versions | dict.fromkeys(touched, batch_id))
        finally:
            new.unpersist()

    def vacuum(self) -> int:
        """Deletes what no bucket of the last commit refers to; not while a batch is written.  The number of folders deleted."""
        _, versions = self.committed()
        used = {f"batch={v}/_bucket={b}" for b, v in versions.items()}
        folder, files = self._files(f"{self.path}/rows")
        n = 0
        for batch in files.listStatus(folder) if files.exists(folder) else ():
            for part in files.listStatus(batch.getPath()):
                if part.isDirectory() and f"{batch.getPath().getName()}/{part.getPath().getName()}" not in used:
                    n += files.delete(part.getPath(), True)
        return n
