"""Questions about order: neighbours of vectors, inequality joins of two large sides, spans that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.nearest import build_index, nearest
from larkspur.operators.running import merged_spans, open_spans, smaller_sums
from larkspur.plans.registry import query
from larkspur.sources.tables import table


@query("""
    WITH each AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    away AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(sum((q.x - e.x) ** 2), 6) AS distance
             FROM each q JOIN each e ON q.pos = e.pos AND q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id GROUP BY ALL)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::int AS rank, id, round(distance, 4) AS distance FROM away QUALIFY rank <= 10""")
def vector_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, among all."""
    vectors = table(spark, folder, "embeddings")
    found = nearest(vectors.where("vec_id % 100 = 0"), build_index(vectors), k=10)
    return found.select("query_id", "rank", "id", F.round("distance", 4).alias("distance"))


@query("""
    WITH priced AS (SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT a.o_orderkey, count(b.o_orderkey) AS n_smaller, round(sum(b.o_totalprice), 2) AS sum_smaller
    FROM priced a LEFT JOIN priced b ON a.c_mktsegment = b.c_mktsegment AND b.o_totalprice < a.o_totalprice GROUP BY a.o_orderkey""")
def smaller_orders_of_segment(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    priced = table(spark, folder, "orders").join(customer, "o_custkey").select("o_orderkey", "c_mktsegment", "o_totalprice")
    found = smaller_sums(priced, priced, by=["c_mktsegment"], on="o_totalprice", value="o_totalprice")
    return found.select("o_orderkey", "n_smaller", F.round("sum_smaller", 2).alias("sum_smaller"))


_SESSIONS = """
    SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 30 MINUTE AS until FROM (
        SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session"""


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events with less than 30 minutes between them, until 30 minutes after the last."""
    grouped = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.max("ts").alias("last"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("since"), (F.col("last") + F.expr("interval 30 minutes")).alias("until"))


@query(f"""
    WITH sessions AS ({_SESSIONS}),
    marks AS (SELECT since AS t, 1 AS step FROM sessions UNION ALL SELECT until, -1 FROM sessions),
    steps AS (SELECT t, sum(step) AS step FROM marks GROUP BY t),
    running AS (SELECT t, sum(step) OVER (ORDER BY t) AS n_open FROM steps)
    SELECT max(n_open)::bigint AS n_open, arg_max(t, (n_open, -epoch_us(t))) AS first_at FROM running""")
def most_sessions_at_once(spark: SparkSession, folder: str) -> DataFrame:
    steps = open_spans(_sessions(spark, folder), by=[], since="since", until="until")
    most = steps.agg(F.max(F.struct("n_open", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("t"), "at")).alias("m"))
    return most.select("m.n_open", F.col("m.at").alias("first_at"))


@query(f"""
    WITH sessions AS ({_SESSIONS}),
    marks AS (SELECT since, until, max(until) OVER (ORDER BY since, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sessions),
    numbered AS (SELECT since, until, sum(CASE WHEN since <= before THEN 0 ELSE 1 END) OVER (ORDER BY since, until ROWS UNBOUNDED PRECEDING) AS k FROM marks)
    SELECT min(since) AS since, max(until) AS until FROM numbered GROUP BY k""")
def times_with_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return merged_spans(_sessions(spark, folder), by=[], since="since", until="until")
