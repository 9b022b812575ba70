"""Scans, joins, rollups, rankings and event windows: one query of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.as_of import as_of_join
from larkspur.plans.registry import query
from larkspur.sources.tables import table


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@query("""
    SELECT n_name, count(*) AS n_customers, round(sum(o_totalprice), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders, nation = (table(spark, folder, t) for t in ("customer", "orders", "nation"))
    both = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("""
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select("o_orderkey", "o_orderpriority")


@query("""
    SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS bigint) AS level, sum(l_quantity) AS sum_qty
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def quantity_rollup(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.sum("l_quantity").alias("sum_qty"))


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS bigint) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
    WHERE place <= 3""")
def top_orders_by_customer(spark: SparkSession, folder: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ranked = table(spark, folder, "orders").withColumn("place", place.cast("long")).where("place <= 3")
    return ranked.select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query("""
    SELECT p.event_id, c.event_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def last_click_before_purchase(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    right = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return as_of_join(events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), right, by=["user_id"], on="ts", width=7 * 86_400).select("event_id", "click_id")


@query("""
    SELECT user_id, CAST(session AS bigint) AS session, count(*) AS n_events, round(sum(value), 4) AS total FROM (
        SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY ALL""")
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    by_session = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    found = by_session.agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long")
    return found.select("user_id", number.alias("session"), "n_events", "total")


@query("""
    SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(avg(value), 6) AS mean
    FROM events GROUP BY ALL""")
def events_by_day(spark: SparkSession, folder: str) -> DataFrame:
    windows = table(spark, folder, "events").groupBy("event_type", F.window("ts", "1 day").alias("w"))
    counted = windows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return counted.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "mean")


@query("""
    SELECT CAST(json_extract_string(props, '$.k') AS bigint) AS k, count(*) AS n FROM events GROUP BY ALL""")
def events_by_property(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("""
    SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def shared_nations(spark: SparkSession, folder: str) -> DataFrame:
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return customer.select(F.col("c_nationkey").alias("nation")).intersect(supplier.select("s_nationkey"))
