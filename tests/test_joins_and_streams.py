"""The as-of and interval joins and the stateful stream operator on odd rows, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from larkspur.operators.as_of import as_of_join
from larkspur.operators.interval import interval_join
from larkspur.operators.quantile import exact_quantiles
from larkspur.streaming.last_seen import last_mark
from larkspur.streaming.runs import event_stream, finished

DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else DAY + dt.timedelta(seconds=seconds)


def test_interval_join_equals_all_pairs(spark):
    draw = random.Random(5)
    spans = [(draw.randrange(3), k, s := draw.randrange(900), s + draw.choice([-5, 0, 10, 60, 400])) for k in range(80)]
    spans += [(None, 80, 0, 900), (0, 81, None, 900), (0, 82, 0, None)]
    points = [(draw.randrange(3), k, draw.randrange(1200)) for k in range(120)] + [(None, 120, 5), (0, 121, None), (0, 121, 60), (0, 121, 60)]
    left = spark.createDataFrame([(g, k, at(a), at(b)) for g, k, a, b in spans], "g long, span long, since timestamp_ntz, until timestamp_ntz")
    right = spark.createDataFrame([(g, k, at(t)) for g, k, t in points], "g long, point long, at timestamp_ntz")
    want = sorted((s[1], p[1]) for s in spans for p in points if None not in (*s, *p) and s[0] == p[0] and s[2] <= p[2] <= s[3])
    for width in (7, 60, 5000):
        got = interval_join(left, right, by=["g"], since="since", until="until", at="at", width=width)
        assert got.columns == ["g", "span", "since", "until", "point", "at"]
        assert sorted((r["span"], r["point"]) for r in got.collect()) == want
    assert interval_join(left.where("false"), right, by=["g"], since="since", until="until", at="at", width=60).count() == 0


def test_as_of_join_takes_the_last_of_equal_times(spark):
    left = spark.createDataFrame([(1, at(5), 10), (1, at(5), 10), (1, at(1), 11), (2, at(9), 12)], "g long, t timestamp_ntz, id long")
    right = spark.createDataFrame([(1, at(5), 1), (1, at(5), 2), (1, at(6), 3), (3, at(0), 4)], "g long, t timestamp_ntz, other long")
    rows = as_of_join(left, right, by=["g"], on="t").collect()
    assert sorted((r["id"], r["other"]) for r in rows if r["other"]) == [(10, 2), (10, 2)] and len(rows) == 4


def _events(spark, folder, part, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(k, at(s), u, kind, 1.0, "{}") for k, s, u, kind in rows], schema).coalesce(1).write.parquet(f"{folder}/{part}")


def test_last_mark_carries_state_over_batches(spark, tmp_path):
    for part, rows in enumerate([
        [(0, 0, 1, "view"), (1, 5, 1, "click"), (2, 5, 1, "buy"), (3, 7, 2, "buy")],
        [(4, 20, 1, "buy"), (5, 21, 1, "click"), (6, 22, 2, "click"), (7, 22, 2, "buy")],
        [(8, 40, 1, "buy"), (9, 41, 2, "buy")],
    ]):
        _events(spark, tmp_path, f"p{part}", rows)
    schema = spark.read.parquet(f"{tmp_path}/p0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    rows = finished(last_mark(stream, by="user_id", on="ts", id="event_id", marks="event_type = 'click'"), "test").collect()
    assert {r["id"]: r["mark_id"] for r in rows} == {0: None, 2: 1, 3: None, 4: 1, 7: 6, 8: 5, 9: 6} and len(rows) == 7


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    _events(spark, tmp_path, "p0", [(k, 600 * k, 1, "click") for k in range(12)])
    _events(spark, tmp_path, "p1", [(50, 60 * 60 * 5, 1, "click")])
    # Spark drops late rows by the watermark that the batch before had, so it shows in the third batch
    _events(spark, tmp_path, "p2", [(51, 0, 1, "click")])
    schema = spark.read.parquet(f"{tmp_path}/p0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    late = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    hours = finished(late.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")), "late")
    assert sorted((r["w"].start.hour, r["n"]) for r in hours.collect()) == [(0, 6), (1, 6)]


def test_event_stream_reads_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    assert finished(event_stream(spark, folder), "all").count() == spark.read.parquet(f"{folder}/events.parquet").count()


def test_as_of_join_equals_a_loop_with_nulls_and_in_stretches(spark):
    draw = random.Random(9)
    some = lambda n: [(draw.choice([0, 1, None]), draw.choice([None, *range(0, 4000, 37)]), k) for k in range(n)]
    lefts, rights = some(120), some(90)
    left = spark.createDataFrame([(g, at(t), k, k) for g, t, k in lefts], "g long, t timestamp_ntz, id long, v long")
    right = spark.createDataFrame([(g, at(t), k) for g, t, k in rights], "g long, t timestamp_ntz, v long")
    want = {}
    for g, t, k in lefts:
        before = [(u, v) for h, u, v in rights if None not in (g, t, u) and h == g and u <= t]
        want[k] = max(before)[1] if before else None
    for width in (None, 60, 1000, 10**6):
        got = as_of_join(left, right, by=["g"], on="t", width=width)
        assert got.columns == ["g", "t", "id", "v", "v_right"]
        rows = got.collect()
        assert {r["id"]: r["v_right"] for r in rows} == want and len(rows) == len(lefts) and all(r["v"] == r["id"] for r in rows)
        assert as_of_join(left, right.where("false"), by=["g"], on="t", width=width).where("v_right is not null").count() == 0


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    values = [*rng.lognormal(3, 4, 3000).tolist(), *[7.0] * 2000, -1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "x double")
    shares = [0.0, 0.1, 0.5, 0.777, 1.0]
    got = exact_quantiles(df, "x", shares, cells=16, few=40)
    assert np.allclose(got, np.quantile(values, shares), rtol=1e-12)
    assert exact_quantiles(df.where("false"), "x", [0.5]) == [None]

