"""State that ends, rows that come late and a sink that is killed, batch by batch."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from larkspur.streaming import upsert
from larkspur.streaming.recent_marks import recent_mark
from larkspur.streaming.runs import finished_in_batches, rocksdb_state, run_in_batches, stream_path
from larkspur.streaming.upsert import UpsertTable

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, user long, kind string"


def batch(spark, rows):
    return spark.createDataFrame([(i, None if s is None else DAY + dt.timedelta(seconds=s), u, k) for i, s, u, k in rows], SCHEMA)


def recent(spark, batches, within=100, late=10):
    with rocksdb_state(spark):
        return finished_in_batches([batch(spark, b) for b in batches], lambda rows: recent_mark(rows, by="user", on="ts", id="id", marks="kind = 'mark'", within_seconds=within, late_seconds=late), "test")


def held(progress):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]


def test_a_mark_counts_for_a_while_and_its_state_ends(spark):
    batches = [
        [(1, 0, 1, "mark"), (2, 50, 1, "other"), (3, 5, 2, "mark"), (4, 5, 2, "other"), (5, 4, 2, "other")],
        [(6, 99, 1, "other"), (7, 101, 1, "other"), (8, 60, 2, None), (9, None, 1, "mark"), (10, 61, None, "mark")],
        [(11, 2_000, 3, "other")],
        [(12, 2_001, 1, "other"), (13, 2_002, 2, "mark"), (14, 2_002, 2, "mark"), (15, 2_003, 2, "other")],
        [(16, 9_000, 3, "other")],
    ]
    out, progress = recent(spark, batches)
    rows = out.collect()
    assert {r.id: r.mark_id for r in rows} == {2: 1, 4: 3, 5: None, 6: 1, 7: None, 8: 3, 11: None, 12: None, 15: 14, 16: None}
    assert len(rows) == 10
    marks = held(progress)
    assert marks[0] > 0 and marks[2] == 0 and marks[3] > 0 and marks[4] == 0, marks


def test_events_behind_the_watermark_are_left_out_of_marks(spark):
    out, progress = recent(spark, [[(1, 1_000, 1, "other")], [(2, 10, 1, "mark"), (3, 995, 1, "mark"), (4, 996, 1, "other")], [(5, 997, 1, "other"), (6, 5, 1, "other")]])
    assert {r.id: r.mark_id for r in out.collect()} == {1: None, 4: 3, 5: 3}
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) >= 1


def rows_of(table):
    return sorted(map(tuple, table.read().select("id", "user", "kind").collect()))


def test_upserts_are_taken_in_once_whatever_is_killed(spark, monkeypatch):
    batches = [
        [(1, 5, 1, "a"), (2, 5, 2, "a"), (3, 9, 1, "b")],
        [(4, 7, 1, "late"), (5, 11, 2, "b"), (6, 1, 3, "a"), (7, None, 4, "x"), (8, 3, None, "x")],
        [(9, 12, 1, "c"), (9, 12, 1, "c"), (10, 12, 1, "b")],
    ]
    path = stream_path(spark, "test")
    table = UpsertTable(spark, f"{path}/table", batch(spark, batches[0]).schema, keys=["user"], order=["ts"], buckets=3)
    assert table.committed() == (-1, {}) and rows_of(table) == []
    sink = lambda rows: rows.writeStream.foreachBatch(table.merge)
    run_in_batches([batch(spark, batches[0])], sink, path)
    first = [(2, 2, "a"), (3, 1, "b")]
    assert rows_of(table) == first

    # killed between write and commit: readers see the old table, and the next run does the batch again
    monkeypatch.setattr(upsert.UpsertTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(StreamingQueryException):
        run_in_batches([batch(spark, batches[1])], sink, path)
    assert rows_of(table) == first
    monkeypatch.undo()
    run_in_batches([batch(spark, []), batch(spark, batches[2])], sink, path)
    want = [(5, 2, "b"), (6, 3, "a"), (10, 1, "b")]
    last, versions = table.committed()
    assert rows_of(table) == want

    # killed between commit and the stream's own progress: the batch comes again and changes nothing
    before = rows_of(table)
    table.merge(batch(spark, [(99, 99, 1, "again")]), last)
    assert table.committed() == (last, versions) and rows_of(table) == before
    assert table.vacuum() > 0 and rows_of(table) == before and table.vacuum() == 0


def test_a_commit_of_another_run_is_not_overwritten(spark):
    path = stream_path(spark, "test")
    table = UpsertTable(spark, path, batch(spark, []).schema, keys=["user"], order=["ts"], buckets=2)
    table.merge(batch(spark, [(1, 1, 1, "a")]), 0)
    with pytest.raises(RuntimeError, match="another run"):
        table._commit(0, {})
    assert rows_of(table) == [(1, 1, "a")]


def test_batches_in_disorder_close_days(spark):
    hours = lambda n: n * 3600
    parts = [[(1, hours(1), 1, "a")], [(2, hours(40), 1, "a")], [(3, hours(2), 1, "a"), (4, hours(30), 1, "a")], [(5, hours(99), 1, "a")]]
    build = lambda rows: rows.withWatermark("ts", "10 hours").groupBy(F.window("ts", "1 day").alias("w")).agg(F.collect_set("id").alias("ids"))
    out, _ = finished_in_batches([batch(spark, p) for p in parts], build, "test")
    assert sorted(sorted(r.ids) for r in out.collect()) == [[1], [2, 4]]
