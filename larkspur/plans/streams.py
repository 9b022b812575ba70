"""Structured Streaming over the events table, each stream run until its source is exhausted.

Windows that the watermark hasn't passed by then are still open, so neither a stream nor its SQL returns them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.registry import query
from larkspur.sources.tables import table
from larkspur.streaming.last_seen import last_mark
from larkspur.streaming.recent_marks import recent_mark
from larkspur.streaming.runs import event_stream, finished, finished_in_batches, rocksdb_state, run_in_batches, stream_path
from larkspur.streaming.upsert import UpsertTable


@query("""
    SELECT event_type, day, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS day, max(ts) OVER () - INTERVAL 1 HOUR AS mark FROM events)
    WHERE day + INTERVAL 1 DAY <= date_trunc('millisecond', mark) GROUP BY event_type, day""")
def stream_days(spark: SparkSession, folder: str) -> DataFrame:
    days = event_stream(spark, folder).withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", "1 day").alias("w"))
    counted = finished(days.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "days")
    return counted.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("""
    WITH each AS (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events)
    SELECT start AS start, count(*) AS n, round(sum(value), 4) AS total FROM each
    WHERE start + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY start""")
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    windows = event_stream(spark, folder).withWatermark("ts", "1 hour").groupBy(F.window("ts", "12 hours", "6 hours").alias("w"))
    counted = finished(windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "sliding")
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""
    SELECT user_id, min(ts) AS opened, count(*) AS n FROM (
        SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
            SELECT *, max(ts) OVER () - INTERVAL 1 HOUR AS mark,
                   CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= date_trunc('millisecond', max(mark))""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_stream(spark, folder).withWatermark("ts", "1 hour")
    found = finished(rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")), "sessions")
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("opened"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_stream(spark, folder)
    twice = rows.unionByName(rows).withWatermark("ts", "1 hour")
    return finished(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"), "distinct")


@query("""
    SELECT c.event_id AS click_id, p.event_id AS purchase_id
    FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR
    WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_stream_join(spark: SparkSession, folder: str) -> DataFrame:
    def side(kind: str, p: str) -> DataFrame:
        rows = event_stream(spark, folder).where(F.col("event_type") == kind)
        return rows.select(F.col("user_id").alias(f"{p}_user"), F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts")).withWatermark(f"{p}_ts", "1 hour")

    near = F.expr("click_user = purchase_user and purchase_ts between click_ts and click_ts + interval 1 hour")
    return finished(side("click", "click").join(side("purchase", "purchase"), near).select("click_id", "purchase_id"), "joined")


@query("""
    SELECT c_nationkey AS nation, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL""")
def stream_static_join(spark: SparkSession, folder: str) -> DataFrame:
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    both = event_stream(spark, folder).join(customer, F.col("user_id") == customer.c_custkey).select(F.col("c_nationkey").alias("nation"))
    return finished(both, "enriched").groupBy("nation").agg(F.count("*").alias("n"))


@query("""
    SELECT p.event_id, c.event_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def stream_last_click(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_stream(spark, folder).where(F.col("event_type").isin("click", "purchase"))
    found = finished(last_mark(rows, by="user_id", on="ts", id="event_id", marks="event_type = 'click'"), "last_click")
    return found.select(F.col("id").alias("event_id"), F.col("mark_id").alias("click_id"))


def _arrivals(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The events in five batches of a fixed order: about eight days each, but one event in ten comes a batch late and one in ten two."""
    events = table(spark, folder, "events").withColumn("arrival", F.expr(_ARRIVAL)).withColumn("ts", F.col("ts").cast("timestamp"))
    return [events.where(F.col("arrival") == k).drop("arrival") for k in range(5)]


# a whole number of days since the start of 2024, by eight
_ARRIVAL = """least(4, greatest(0, cast(floor(datediff(ts, DATE'2024-01-01') / 8) as int)) + CASE event_id % 10 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END)"""
_SQL_ARRIVALS = """
    arrivals AS (SELECT *, least(4, greatest(0, floor(date_diff('day', DATE '2024-01-01', ts::date) / 8)::int) + CASE event_id % 10 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END) AS batch FROM events),
    latest AS (SELECT k AS batch, date_trunc('millisecond', max(ts)) - INTERVAL {delay} AS mark FROM arrivals JOIN range(6) r(k) ON batch < k GROUP BY k)"""


@query(f"""
    WITH {_SQL_ARRIVALS.format(delay="9 DAY")},
    taken AS (SELECT a.*, time_bucket(INTERVAL 1 DAY, ts) AS day FROM arrivals a LEFT JOIN latest l USING (batch) WHERE mark IS NULL OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > mark)
    SELECT event_type, day, count(*) AS n, round(sum(value), 4) AS total FROM taken
    WHERE day + INTERVAL 1 DAY <= (SELECT max(mark) FROM latest) GROUP BY event_type, day""")
def stream_late_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sums over batches in disorder: rows of days that the watermark has closed before their batch are left out."""

    def days(rows: DataFrame) -> DataFrame:
        counted = rows.withWatermark("ts", "9 days").groupBy("event_type", F.window("ts", "1 day").alias("w"))
        return counted.agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    out, _ = finished_in_batches(_arrivals(spark, folder), days, "late-days")
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query(f"""
    WITH {_SQL_ARRIVALS.format(delay="9 DAY")}
    SELECT event_id, ts FROM arrivals JOIN latest USING (batch) WHERE ts <= mark""")
def stream_dropped_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events that a deduplicating stream has left out, as they came behind the watermark."""
    out, _ = finished_in_batches(_arrivals(spark, folder), lambda rows: rows.withWatermark("ts", "9 days").dropDuplicatesWithinWatermark(["event_id"]), "taken")
    return table(spark, folder, "events").join(out.select("event_id"), "event_id", "left_anti").select("event_id", "ts")


@query("""
    SELECT p.event_id, CASE WHEN p.ts - c.ts <= INTERVAL 12 HOUR THEN c.event_id END AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def stream_recent_click(spark: SparkSession, folder: str) -> DataFrame:
    """The user's last click within twelve hours before each purchase; a click's state ends when no purchase can need it."""
    events = table(spark, folder, "events").where(F.col("event_type").isin("click", "purchase")).withColumn("ts", F.col("ts").cast("timestamp"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    halves = [events.where(early), events.where(~early)]
    with rocksdb_state(spark):
        out, _ = finished_in_batches(halves, lambda rows: recent_mark(rows, by="user_id", on="ts", id="event_id", marks="event_type = 'click'", within_seconds=12 * 3600, late_seconds=3600), "recent-click")
    return out.select(F.col("id").alias("event_id"), F.col("mark_id").alias("click_id"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last event, kept up to date over batches in disorder; every batch comes twice, as after a lost commit."""
    batches = _arrivals(spark, folder)
    path = stream_path(spark, "upserts")
    newest = UpsertTable(spark, f"{path}/table", batches[0].schema, keys=["user_id"], order=["ts", "event_id"], buckets=4)

    def twice(batch: DataFrame, batch_id: int) -> None:
        newest.merge(batch, batch_id)
        newest.merge(batch, batch_id)

    run_in_batches(batches, lambda rows: rows.writeStream.foreachBatch(twice), path)
    return newest.read().select("user_id", "event_id", "event_type", "value")
