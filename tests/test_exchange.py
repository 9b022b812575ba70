"""Arrow files: what a filter opens, commits and aborts; and the functions in Python on odd values."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from larkspur.plans.exchange import weighted_median
from larkspur.plans.surface import Instalments
from larkspur.sources.arrow_files import MANIFEST, ArrowFiles, read_arrow_files, read_manifest, write_arrow_files


def rows(spark, a, b):
    return spark.range(a, b, numPartitions=3).selectExpr("id", "if(id % 5 = 0, null, id / 2) as half", "concat('n', id % 100) as name", "timestamp_ntz'2024-01-01' + make_dt_interval(id) as at", "cast(null as int) as none")


def opened(df):
    return df.rdd.getNumPartitions()


def test_round_trip_and_pruning(spark, tmp_path):
    path, given = f"{tmp_path}/t", rows(spark, 0, 1000)
    write_arrow_files(given, path, file_rows=100)
    back = read_arrow_files(spark, path)
    assert back.schema.simpleString() == given.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, given.collect()))
    every = len(read_manifest(path)["files"])
    assert every >= 10 and opened(back) == every
    for condition in ("id < 50", "id = 731", "id in (5, 998)", "half >= 499", "half > 499.4", "id >= 990 and half is not null", "at > timestamp_ntz'2026-09-01'", "name = 'zz'", "none > 3", "id <= -1"):
        some = back.where(condition)
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, given.where(condition).collect())), condition
        assert opened(some) < every / 2, condition
    assert opened(back.where("half is null")) == every and back.where("half is null").count() == 200


def test_nan_is_above_all_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (math.nan,)], "x double").coalesce(1)
    write_arrow_files(df, f"{tmp_path}/t")
    assert read_arrow_files(spark, f"{tmp_path}/t").where("x > 5").count() == 1


def test_modes_and_a_table_of_no_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_arrow_files(rows(spark, 0, 10), path)
    write_arrow_files(rows(spark, 10, 20), path)
    assert read_arrow_files(spark, path).count() == 20
    with pytest.raises(Exception, match="another schema"):
        write_arrow_files(spark.range(3), path)
    assert read_arrow_files(spark, path).count() == 20
    write_arrow_files(spark.range(3), path, mode="overwrite")
    assert [r.id for r in read_arrow_files(spark, path).orderBy("id").collect()] == [0, 1, 2]
    names = {f["name"] for f in read_manifest(path)["files"]}
    assert {p.name for p in (tmp_path / "t").glob("*.arrow")} == names
    write_arrow_files(spark.range(0), path, mode="overwrite")
    assert read_arrow_files(spark, path).count() == 0


def test_a_task_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_arrow_files(rows(spark, 0, 10), path)
    before = (tmp_path / "t" / MANIFEST).read_text()
    broken = rows(spark, 0, 3000).withColumn("half", F.when(F.col("id") == 2999, F.raise_error(F.lit("lost"))).otherwise(F.col("half")))
    with pytest.raises(Exception, match="lost"):
        write_arrow_files(broken, path, mode="overwrite", file_rows=50)
    assert (tmp_path / "t" / MANIFEST).read_text() == before and read_arrow_files(spark, path).count() == 10
    # files of tasks that ended are deleted; those of the task that failed aren't in any manifest
    schema = rows(spark, 0, 1).schema
    writer = ArrowFiles({"path": path}).writer(schema, False)
    import pyarrow as pa

    message = writer.write(iter([pa.record_batch({"id": [1]})]))
    assert (tmp_path / "t" / message.files[0]["name"]).exists()
    writer.abort([message, None])
    assert not (tmp_path / "t" / message.files[0]["name"]).exists() and json.loads(before)["files"] == read_manifest(path)["files"]


def test_dates_before_1970(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(1950, 1, 1), dt.date(1950, 1, 1)), (dt.datetime(2000, 1, 1), dt.date(2000, 1, 1))], "t timestamp_ntz, d date").coalesce(1)
    write_arrow_files(df, f"{tmp_path}/t", file_rows=1)
    back = read_arrow_files(spark, f"{tmp_path}/t")
    assert opened(back.where("d < date'1960-01-01'")) == 1 == back.where("d < date'1960-01-01'").count()
    assert opened(back.where("t >= timestamp_ntz'1999-01-01'")) == 1 == back.where("t >= timestamp_ntz'1999-01-01'").count()


def test_weighted_median_of_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 5.0), ("b", None, 1.0), ("b", 3.0, None), ("c", 5.0, 0.0), ("c", 6.0, 2.0), ("d", 1.0, 1.0), ("d", 2.0, 1.0)], "g string, v double, w double")
    got = {r.g: r.m for r in df.groupBy("g").agg(weighted_median("v", "w").alias("m")).collect()}
    assert got == {"a": 9.0, "b": None, "c": 6.0, "d": 1.0}


def test_instalments_end_whatever_the_limit():
    assert list(Instalments.func().eval(5.0, 1.0)) == [] == list(Instalments.func().eval(None, 1.0))
    assert list(Instalments.func().eval(25.0, 1.0)) == [(1, 2.0, 23.0), (2, 2.0, 21.0), (3, 2.0, 19.0), *((k, 1.0, 22.0 - k) for k in range(4, 14))]
