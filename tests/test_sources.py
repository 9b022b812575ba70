"""Writes and reads of files, and the aggregate functions on small groups."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.functions.stats import geometric_mean, sample_kurtosis, sample_skewness, weighted_mean
from larkspur.sources.files import read_checked, write_partitioned


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_partitioned_write_keeps_all_rows_and_prunes(spark, tmp_path, capsys, fmt):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("k"), F.lit("x, \"y\"").alias("s"))
    path = f"{tmp_path}/out"
    write_partitioned(rows, path, by=["k"], fmt=fmt, spread=3)
    back = spark.read.schema("id long, s string, k string").format(fmt).load(path)
    assert sorted(map(tuple, back.select("id", "k", "s").collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "out" / "k=many").glob("part-*"))) <= 3
    few = back.where("k = 'few'")
    assert few.count() == 200
    few.explain()
    assert "PartitionFilters: [isnotnull(k" in capsys.readouterr().out


def test_partitioned_write_of_an_empty_table(spark, tmp_path):
    write_partitioned(spark.range(0).withColumn("k", F.lit(1)), f"{tmp_path}/none", by=["k"])
    assert spark.read.schema("id long, k int").parquet(f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("fmt", "text"), [("csv", "1,a\nword,b\n3,\n"), ("json", '{"n": 1, "s": "a"}\n{"n": 2, "s": \n{"n": 3}\n')])
def test_broken_records_are_kept_aside(spark, tmp_path, fmt, text):
    (tmp_path / "in.txt").write_text(text)
    good, bad = read_checked(spark, str(tmp_path), StructType().add("n", "long").add("s", "string"), fmt=fmt)
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (3, None)]
    assert [r["record"] for r in bad.collect()] == [text.split("\n")[1]]


def test_broken_values_are_found_whatever_a_query_needs(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("1", 2.0, "a"), ("x", 3.0, "a"), ("4", 5.0, "b")], "n string, v double, k string")
    write_partitioned(rows, f"{tmp_path}/t", by=["k"], fmt="csv")
    good, bad = read_checked(spark, f"{tmp_path}/t", StructType().add("n", "long").add("v", "double").add("k", "string"), fmt="csv", by=["k"])
    assert good.agg(F.sum("v")).first()[0] == 7.0 and good.count() == 2 and bad.count() == 1
    assert [(r.k, r["count"]) for r in bad.groupBy("k").count().collect()] == [("a", 1)]
    assert good.where("k = 'b'").count() == 1
    good.where("k = 'b'").explain()
    assert "PartitionFilters: [isnotnull(k" in capsys.readouterr().out


def test_statistics_of_small_groups(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", None, 9.0), ("b", -1.0, 0.0), ("c", 2.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 1.0)], "g string, x double, w double")
    got = {r["g"]: r for r in rows.groupBy("g").agg(sample_skewness("x").alias("s"), sample_kurtosis("x").alias("k"), weighted_mean(F.col("x"), F.col("w")).alias("m"), geometric_mean(F.col("x")).alias("e")).collect()}
    assert all(r["s"] is None and r["k"] is None for r in got.values())
    assert got["a"]["m"] == 1.75 and got["b"]["m"] is None and got["c"]["m"] == 2.0
    assert math.isclose(got["a"]["e"], math.sqrt(2)) and got["b"]["e"] is None
