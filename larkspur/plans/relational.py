"""Filters, joins, aggregations, windows, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.interval import interval_join
from larkspur.plans.registry import query
from larkspur.sources.tables import table


@query("""
    SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1050 THEN 'middle' ELSE 'high' END AS band,
           p_size BETWEEN 10 AND 20 AS middle_sized
    FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_brand LIKE '%3' AND p_size > 3""")
def part_price_bands(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").where(F.col("p_type").isin("ECONOMY", "PROMO") & F.col("p_brand").like("%3") & (F.col("p_size") > 3))
    band = F.when(F.col("p_retailprice") < 950, "low").when(F.col("p_retailprice") < 1050, "middle").otherwise("high")
    return part.select("p_partkey", band.alias("band"), F.col("p_size").between(10, 20).alias("middle_sized"))


@query("""
    SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts,
           count(*) FILTER (l_discount > 0.05) AS discounted, round(max(l_extendedprice) FILTER (l_quantity < 10), 2) AS top_small
    FROM lineitem GROUP BY l_returnflag""")
def distinct_and_conditional(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.count_distinct("l_partkey").alias("parts"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.round(F.max(F.when(F.col("l_quantity") < 10, F.col("l_extendedprice"))), 2).alias("top_small"),
    )


@query("""
    SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS bigint) AS level,
           count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def orders_cube(spark: SparkSession, folder: str) -> DataFrame:
    cube = table(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority")
    return cube.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())""")
def part_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderstatus, coalesce(f, 0) AS f, coalesce(o, 0) AS o
    FROM (SELECT o_orderstatus, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus)""")
def line_status_pivot(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderstatus").pivot("l_linestatus", ["F", "O"]).count()
    return both.select("o_orderstatus", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""
    SELECT s_suppkey, s_name, CAST(count(l_orderkey) AS bigint) AS n_lines
    FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) ON s_suppkey = l_suppkey GROUP BY ALL""")
def lines_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "lineitem").where("l_quantity > 49").groupBy("l_suppkey").count()
    supplier = table(spark, folder, "supplier")
    both = supplier.join(counted, supplier.s_suppkey == counted.l_suppkey, "left")
    return both.select("s_suppkey", "s_name", F.coalesce("count", F.lit(0)).alias("n_lines"))


@query("""
    SELECT coalesce(c.nation, s.nation) AS nation, c.n AS customers, s.n AS suppliers
    FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal < -500 GROUP BY ALL) c
    FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) s ON c.nation = s.nation""")
def nations_on_either_side(spark: SparkSession, folder: str) -> DataFrame:
    poor = table(spark, folder, "customer").where("c_acctbal < -500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    rich = table(spark, folder, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return poor.join(rich, "nation", "full")


@query("""
    SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderpriority LIKE '1%') ON c_custkey = o_custkey""")
def customers_with_urgent_orders(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders").where("o_orderpriority like '1%'")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_semi").select("c_custkey")


@query("""
    SELECT c.event_id AS click_id, p.event_id AS purchase_id
    FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOUR
    WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def purchases_soon_after_clicks(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    clicks = clicks.select("user_id", "click_id", F.col("ts").alias("since"), F.expr("ts + interval 2 hours").alias("until"))
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return interval_join(clicks, bought, by=["user_id"], since="since", until="until", at="ts", width=7200).select("click_id", "purchase_id")


@query("""
    SELECT event_id, lag(event_id) OVER w AS before, lead(event_type) OVER w AS next_type,
           date_diff('second', lag(ts) OVER w, ts) AS gap, first_value(event_id) OVER w AS opened
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbours_in_time(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda c: F.date_trunc("second", c).cast("timestamp").cast("long")
    return table(spark, folder, "events").select(
        "event_id",
        F.lag("event_id").over(w).alias("before"),
        F.lead("event_type").over(w).alias("next_type"),
        (seconds(F.col("ts")) - seconds(F.lag("ts").over(w))).alias("gap"),
        F.first("event_id").over(w).alias("opened"),
    )


@query("""
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW), 4) AS week,
           round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS near_mean
    FROM events""")
def framed_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    near = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 1)
    week = F.expr("sum(value) over (partition by user_id order by ts range between interval 7 days preceding and current row)")
    return rows.select("event_id", F.round(week, 4).alias("week"), F.round(F.avg("value").over(near), 4).alias("near_mean"))


@query("""
    SELECT o_orderkey, CAST(rank() OVER w AS bigint) AS place, CAST(dense_rank() OVER w AS bigint) AS step,
           CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS bigint) AS quarter,
           round(percent_rank() OVER w, 6) AS share
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def order_ranks(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    quarters = F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.rank().over(w).cast("long").alias("place"),
        F.dense_rank().over(w).cast("long").alias("step"),
        quarters.cast("long").alias("quarter"),
        F.round(F.percent_rank().over(w), 6).alias("share"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""")
def dearest_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(25)


@query("""
    SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier""")
def nations_except_all(spark: SparkSession, folder: str) -> DataFrame:
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return customer.select(F.col("c_nationkey").alias("nation")).exceptAll(supplier.select("s_nationkey"))


@query("""
    SELECT 'customer' AS side, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL
    UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL""")
def parties_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    sides = [table(spark, folder, t).select(F.lit(t).alias("side"), F.col(c).alias("nation")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return sides[0].unionByName(sides[1]).groupBy("side", "nation").agg(F.count("*").alias("n"))


@query("""
    SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)""")
def parts_above_mean(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    mean = part.agg(F.avg("p_retailprice").alias("limit"))  # one row
    return part.join(F.broadcast(mean), F.col("p_retailprice") > F.col("limit")).select("p_partkey", "p_retailprice")


@query("""
    SELECT n_nationkey, c_custkey, c_acctbal FROM nation, LATERAL (
        SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)""")
def richest_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    # min_by over bounded arrays would do too; a ranked window keeps two rows a nation after one shuffle
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    top = table(spark, folder, "customer").withColumn("place", place).where("place <= 2")
    nation = table(spark, folder, "nation")
    return nation.join(top, nation.n_nationkey == top.c_nationkey).select("n_nationkey", "c_custkey", "c_acctbal")
