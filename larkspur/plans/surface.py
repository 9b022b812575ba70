"""Lateral joins, multiset operations, maps, vectors, and functions in Python where Spark has none."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from larkspur.operators.as_of import as_of_join
from larkspur.operators.quantile import exact_quantiles
from larkspur.plans.registry import query
from larkspur.sources.tables import table

MOST_LABELS = 4096  # whose centroids are broadcast


@query("""
    SELECT n_nationkey, s_suppkey, s_acctbal FROM nation, LATERAL (
        SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2)""")
def lateral_top_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "supplier").where(F.col("s_nationkey") == F.col("n_nationkey").outer())
    top = own.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(2).select("s_suppkey", "s_acctbal")
    return table(spark, folder, "nation").lateralJoin(top).select("n_nationkey", "s_suppkey", "s_acctbal")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def nations_intersect_all(spark: SparkSession, folder: str) -> DataFrame:
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return customer.select(F.col("c_nationkey").alias("nation")).intersectAll(supplier.select("s_nationkey"))


@query("SELECT o_custkey % 1000 AS key FROM orders EXCEPT SELECT s_suppkey * 2 FROM supplier")
def keys_except(spark: SparkSession, folder: str) -> DataFrame:
    orders, supplier = table(spark, folder, "orders"), table(spark, folder, "supplier")
    return orders.select((F.col("o_custkey") % 1000).alias("key")).subtract(supplier.select(F.col("s_suppkey") * 2))


@query("""
    SELECT o_custkey, sum(n)::bigint AS n_orders, max(n) FILTER (o_orderpriority = '1-URGENT')::bigint AS urgent,
           string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) FILTER (n > 1) AS repeated
    FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def priorities_as_map(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    maps = counted.groupBy("o_custkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderpriority", "n")))).alias("m"))
    often = F.map_entries(F.map_filter("m", lambda k, v: v > 1))
    said = F.array_join(F.transform(often, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    urgent = F.try_element_at("m", F.lit("1-URGENT"))
    return maps.select("o_custkey", total.alias("n_orders"), urgent.alias("urgent"), F.when(F.size(often) > 0, said).alias("repeated"))


@query("""
    WITH means AS (SELECT label, pos, round(avg(x), 6) AS c FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
    each AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    dots AS (SELECT vec_id, label, round(sum(x * c), 4) AS dot FROM each JOIN means USING (pos) GROUP BY ALL)
    SELECT vec_id, max(dot) AS dot, arg_max(label, (dot, -label)) AS nearest FROM dots GROUP BY vec_id""")
def nearest_centroids(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    means = vectors.select("label", F.posexplode("e").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("c"))
    centroids = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "c")))["c"].alias("c"))
    # one row is sent to all tasks: labels are counted first, a class of vectors each
    if centroids.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels; use operators.nearest with their centroids as the index")
    every = centroids.agg(F.collect_list(F.struct("label", "c")).alias("centroids"))
    dot = lambda c: F.round(F.aggregate(F.zip_with("e", c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 4)
    scored = F.transform("centroids", lambda x: F.struct(dot(x["c"]).alias("dot"), (-x["label"]).alias("order")))
    best = vectors.join(F.broadcast(every)).select("vec_id", F.array_max(scored).alias("best"))
    return best.select("vec_id", "best.dot", (-F.col("best.order")).alias("nearest"))


@F.pandas_udf(StringType())
def composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode's composed form (NFC); null for null."""
    for part in texts:
        yield part.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@query("SELECT conv_id, turn, nfc_normalize(text) AS text FROM conversations")
def composed_turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", composed("text").alias("text"))


@F.udtf(returnType=StructType().add("step", IntegerType()).add("paid", DoubleType()).add("rest", DoubleType()))
class Instalments:
    """Monthly payments of a price: a tenth of what is left, in whole units, until less than a limit is left or nothing is to pay."""

    def eval(self, price: float | None, limit: float) -> Iterator[tuple[int, float, float]]:
        step, rest = 0, price
        while rest is not None and rest >= limit:
            paid = float(rest // 10)
            if paid <= 0:
                return
            step, rest = step + 1, rest - paid
            yield step, paid, rest


@query("""
    WITH RECURSIVE plan(p_partkey, step, paid, rest) AS (
        SELECT p_partkey, 0, 0::double, p_retailprice FROM part
        UNION ALL SELECT p_partkey, step + 1, floor(rest / 10), rest - floor(rest / 10) FROM plan WHERE rest >= 700)
    SELECT p_partkey, step::int AS step, paid, round(rest, 4) AS rest FROM plan WHERE step > 0""")
def instalments(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    each = part.lateralJoin(Instalments(F.col("p_retailprice").outer(), F.lit(700.0)))
    return each.select("p_partkey", "step", "paid", F.round("rest", 4).alias("rest"))


@query("SELECT round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.99), 4) AS q99 FROM orders")
def exact_order_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    q1, q99 = exact_quantiles(table(spark, folder, "orders"), "o_totalprice", [0.25, 0.99])
    return spark.createDataFrame([(q1, q99)], "q1 double, q99 double").select(F.round("q1", 4).alias("q1"), F.round("q99", 4).alias("q99"))


@query("""
    SELECT p.event_id, v.value AS last_value
    FROM (SELECT * FROM events WHERE event_type = 'signup') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def last_view_in_stretches(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    left = events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"))
    return as_of_join(left, right, by=["user_id"], on="ts", width=86_400).select("event_id", "last_value")
