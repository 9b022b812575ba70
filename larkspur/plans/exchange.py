"""Tables that go out in another format and come back: partitioned text with broken records, and Arrow files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larkspur.plans.registry import query
from larkspur.sources.arrow_files import read_arrow_files, write_arrow_files
from larkspur.sources.files import read_checked, write_partitioned
from larkspur.sources.shared import new_path
from larkspur.sources.tables import table


@query("""
    SELECT o_orderpriority, count(*) FILTER (o_orderkey % 11 > 0) AS n_good, count(*) FILTER (o_orderkey % 11 = 0) AS n_bad,
           round(sum(o_totalprice) FILTER (o_orderkey % 11 > 0), 2) AS total FROM orders GROUP BY o_orderpriority""")
def orders_through_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as CSV by priority, a key in eleven replaced by a word, and read again with the broken records aside."""
    key = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("no. "), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    out = table(spark, folder, "orders").select(key.alias("o_orderkey"), "o_totalprice", "o_orderpriority")
    path = new_path(spark, "orders-csv")
    write_partitioned(out, path, by=["o_orderpriority"], fmt="csv")
    schema = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").schema
    good, bad = read_checked(spark, path, schema, fmt="csv", by=["o_orderpriority"])
    kept = good.groupBy("o_orderpriority").agg(F.count("*").alias("n_good"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return kept.join(bad.groupBy("o_orderpriority").agg(F.count("record").alias("n_bad")), "o_orderpriority").select("o_orderpriority", "n_good", "n_bad", "total")


@query("""
    SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY event_type""")
def events_through_arrow_files(spark: SparkSession, folder: str) -> DataFrame:
    """Events in Arrow files by time; a filter on the time opens only the files whose range it meets."""
    path = new_path(spark, "events-arrow")
    by_time = table(spark, folder, "events").repartitionByRange("ts").sortWithinPartitions("ts")
    write_arrow_files(by_time, path, mode="overwrite")
    two_days = read_arrow_files(spark, path).where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'")
    return two_days.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@F.pandas_udf(DoubleType())
def weighted_median(values: pd.Series, weights: pd.Series) -> float:
    """The least value up to which half the weight lies; pairs with a null, and weights that aren't positive, don't count, null without any.

    The group's values come together in one task, so groups should be small.
    """
    v, w = values.to_numpy(float), weights.to_numpy(float)
    some = ~np.isnan(v) & (w > 0)
    if not some.any():
        return None
    order = np.argsort(v[some], kind="stable")
    v, w = v[some][order], np.cumsum(w[some][order])
    return float(v[np.searchsorted(w, w[-1] / 2)])


@query("""
    WITH each AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS w,
                         sum(l_quantity) OVER (PARTITION BY l_suppkey) AS whole FROM lineitem)
    SELECT l_suppkey, min(v) AS middle_price FROM each WHERE w >= whole / 2 GROUP BY l_suppkey""")
def middle_price_of_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """The median price of a supplier's lines, weighted by quantity: an aggregate that Spark lacks.  A supplier has some hundred lines at any scale."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy("l_suppkey").agg(weighted_median("l_extendedprice", "l_quantity").alias("middle_price"))
