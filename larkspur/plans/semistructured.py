"""VARIANT values, mergeable distinct counts and sequences of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.distinct_counts import distinct_bitmaps, merged_counts
from larkspur.operators.patterns import match_sequence
from larkspur.plans.registry import query
from larkspur.sources.shared import written
from larkspur.sources.tables import table
from larkspur.sources.variants import entries, shredded

# every seventh text loses its end, so that it is no JSON any more
_CUT = "CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END"


@query(f"""
    SELECT event_id, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.k')::int END AS k, NOT json_valid(t) AS broken
    FROM (SELECT event_id, {_CUT} AS t FROM events) WHERE NOT json_valid(t) OR json_extract_string(t, '$.k')::int >= 50""")
def shredded_props(spark: SparkSession, folder: str) -> DataFrame:
    """Properties cut into typed columns and written; the filter reads these, broken records are kept as nulls."""
    events = table(spark, folder, "events").select("event_id", F.expr(_CUT).alias("props"))
    typed = shredded(events, "props", {"k": ("$.k", "int")})
    narrow = written(typed.select("event_id", "k", F.col("parsed").isNull().alias("broken")), "shredded")
    return narrow.where("broken or k >= 50")


@query("""
    WITH b AS (SELECT event_id, props, event_type FROM events),
    each AS (SELECT event_id, unnest(['k', 'type', 'twice']) AS key,
                    unnest([json_extract_string(props, '$.k'), event_type, (2 * json_extract_string(props, '$.k')::int)::varchar]) AS value FROM b)
    SELECT key, value, count(*) AS n, min(event_id) AS first_id FROM each GROUP BY key, value""")
def variant_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of objects of mixed types, a row each, counted by key and value."""
    events = table(spark, folder, "events")
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    made = events.select("event_id", F.to_variant_object(F.struct(k.alias("k"), F.col("event_type").alias("type"), (2 * k).cast("string").alias("twice"))).alias("v"))
    rows = entries(made, "v").select("event_id", "key", F.variant_get("value", "$", "string").alias("value"))
    return rows.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
    SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::bigint AS grouping_id, count(DISTINCT o_custkey) AS n_customers
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())""")
def customers_by_any_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct customers of each status and priority, and of all coarser groups, from bitmaps that are made once."""
    by = ["o_orderstatus", "o_orderpriority"]
    bitmaps = distinct_bitmaps(table(spark, folder, "orders"), by=by, value="o_custkey")
    return merged_counts(bitmaps, by=by, sets=[by, by[:1], by[1:], []], count="n_customers")


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, ts FROM events),
    ends AS (SELECT s.user_id, s.event_id AS first_id, s.ts AS first_ts, p.event_id AS last_id, p.ts AS last_ts
             FROM e s JOIN e p ON s.user_id = p.user_id AND s.event_type = 'signup' AND p.event_type = 'purchase' AND p.ts <= s.ts + INTERVAL 3 DAY),
    found AS (SELECT user_id, first_id, last_id, last_ts, count(*) AS n_between FROM ends JOIN e v USING (user_id)
              WHERE v.event_type = 'view' AND (first_ts, first_id) < (v.ts, v.event_id) AND (v.ts, v.event_id) < (last_ts, last_id) GROUP BY ALL)
    SELECT user_id, first_id, last_id, n_between FROM found QUALIFY row_number() OVER (PARTITION BY first_id ORDER BY last_ts DESC, last_id DESC) = 1""")
def signup_view_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """From each signup to the user's last purchase within three days, if a view lies between; and how many do."""
    steps = [f"event_type = '{kind}'" for kind in ("signup", "view", "purchase")]
    return match_sequence(table(spark, folder, "events"), by="user_id", on="ts", id="event_id", steps=steps, within=3 * 86_400)
