"""String, date, math, JSON and array functions over whole tables, and sliding windows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.quantile import exact_quantiles
from larkspur.plans.registry import query
from larkspur.sources.tables import table


@query("""
    SELECT c_custkey, upper(c_mktsegment) AS segment, substring(c_name, 1, 4) AS head, CAST(length(c_name) AS bigint) AS size,
           replace(c_name, 'Customer', 'C') AS short, lpad(CAST(c_custkey AS varchar), 8, '0') AS padded,
           regexp_extract(c_name, '[0-9]+') AS digits, reverse(c_mktsegment) AS backwards
    FROM customer""")
def string_functions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.upper("c_mktsegment").alias("segment"),
        F.substring("c_name", 1, 4).alias("head"),
        F.length("c_name").cast("long").alias("size"),
        F.replace("c_name", F.lit("Customer"), F.lit("C")).alias("short"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.regexp_extract("c_name", "[0-9]+", 0).alias("digits"),
        F.reverse("c_mktsegment").alias("backwards"),
    )


@query("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS bigint) AS y, CAST(quarter(o_orderdate) AS bigint) AS q, CAST(isodow(o_orderdate) AS bigint) AS weekday,
           CAST(date_trunc('month', o_orderdate) AS timestamp) AS month, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS date)) AS bigint) AS age,
           CAST(o_orderdate + INTERVAL 3 MONTH AS timestamp) AS later, strftime(o_orderdate, '%Y-%m') AS label
    FROM orders""")
def date_functions(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.year(day).cast("long").alias("y"),
        F.quarter(day).cast("long").alias("q"),
        (F.weekday(day) + 1).cast("long").alias("weekday"),
        F.date_trunc("month", day).cast("timestamp_ntz").alias("month"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("age"),
        F.expr("o_orderdate + interval 3 months").alias("later"),
        F.date_format(day, "yyyy-MM").alias("label"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_extendedprice), 6) AS log,
           round(pow(1 + l_discount, 3), 6) AS grown, CAST(floor(l_extendedprice / 100) AS bigint) AS hundreds,
           l_partkey % 7 AS seventh, greatest(l_discount, l_tax) AS larger, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio
    FROM lineitem""")
def math_functions(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.sqrt(price), 6).alias("root"),
        F.round(F.ln(price), 6).alias("log"),
        F.round(F.pow(1 + F.col("l_discount"), F.lit(3)), 6).alias("grown"),
        F.floor(price / 100).cast("long").alias("hundreds"),
        (F.col("l_partkey") % 7).alias("seventh"),
        F.greatest("l_discount", "l_tax").alias("larger"),
        F.round(F.try_divide(price, F.col("l_discount")), 4).alias("ratio"),
    )


@query("""
    SELECT round(var_samp(l_quantity), 6) AS variance, round(stddev_pop(l_tax), 8) AS spread, round(corr(l_quantity, l_extendedprice), 6) AS r,
           round(covar_samp(l_discount, l_tax), 8) AS covariance, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, median(l_quantity) AS middle
    FROM lineitem""")
def line_statistics(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    p90 = exact_quantiles(lines, "l_extendedprice", [0.9])[0]  # as an aggregate it would hold all distinct prices in one task
    middle = exact_quantiles(lines, "l_quantity", [0.5])[0]
    return lines.agg(
        F.round(F.var_samp("l_quantity"), 6).alias("variance"),
        F.round(F.stddev_pop("l_tax"), 8).alias("spread"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
        F.round(F.covar_samp("l_discount", "l_tax"), 8).alias("covariance"),
        F.round(F.lit(p90).cast("double"), 4).alias("p90"),
        F.lit(middle).cast("double").alias("middle"),
    )


@query("""
    SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities,
           arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, bool_or(o_orderstatus = 'P') AS pending
    FROM orders GROUP BY o_custkey""")
def customer_profile(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("pending"),
    )


@query("""
    SELECT label, CAST(pos AS bigint) AS pos, round(avg(x), 5) AS mean
    FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL""")
def embedding_centroids(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("""
    SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) AS norm,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS bigint) AS positive, round(list_max(embedding)::double, 5) AS top
    FROM embeddings""")
def array_functions(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.round(F.array_max(e), 5).alias("top"),
    )


@query("""
    SELECT start AS start, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events)
    GROUP BY start""")
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    windows = table(spark, folder, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w"))
    counted = windows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS bigint) AS k, CAST(len(json_keys(props)) AS bigint) AS n_keys FROM events""")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    keys = F.size(F.json_object_keys("props")).cast("long")
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), keys.alias("n_keys"))
