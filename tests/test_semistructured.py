"""Event sequences against an automaton in plain Python, bitmaps against sets, variants on broken text."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators.distinct_counts import distinct_bitmaps, merged_counts
from larkspur.operators.patterns import match_sequence
from larkspur.sources.variants import entries, shredded

DAY = dt.datetime(2024, 1, 1)


def walked(events, letters, within):
    """An automaton started at each first event, fed with what follows."""
    out = []
    for g in {e[0] for e in events}:
        own = sorted((t, i, k) for h, t, i, k in events if h == g and k in letters)
        for n, (t, i, k) in enumerate(own):
            if k != letters[0]:
                continue
            state, end, between, seen = 1, None, 0, 0
            for u, j, kind in own[n + 1 :]:
                if u > t + within:
                    break
                if kind == letters[-1] and state == len(letters) - 1:
                    end, between = j, seen
                elif state < len(letters) - 1 and kind == letters[state]:
                    state += 1
                seen += kind in letters[1:-1]
            if end is not None:
                out.append((g, i, end, between))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcd"])
def test_sequences_equal_an_automaton(spark, letters):
    draw = random.Random(len(letters))
    events = [(draw.choice("xyy"), draw.randrange(120), i, draw.choice("aabbccdz")) for i in range(260)]
    odd = [(None, 1, 900, "a"), ("x", None, 901, "b"), ("x", 1, None, "c"), ("x", 5, 902, None)]
    rows = [(g, None if t is None else DAY + dt.timedelta(seconds=t), i, k) for g, t, i, k in events + odd]
    df = spark.createDataFrame(rows, "g string, at timestamp_ntz, i long, kind string").withColumn("step", F.lit(1)).withColumn("t", F.lit(1))
    for within, width in ((10, None), (10, 10), (25, 30), (0, None), (200, 1)):
        got = match_sequence(df, by="g", on="at", id="i", steps=[f"kind = '{k}'" for k in letters], within=within, width=width)
        assert sorted(map(tuple, got.collect())) == walked(events, letters, within), (within, width)
    assert match_sequence(df.where("false"), by="g", on="at", id="i", steps=["true", "true"], within=5).count() == 0


def test_bitmaps_merge_to_exact_counts(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 2]), draw.choice([None, draw.randrange(-40_000, 40_000), 7])) for _ in range(400)] + [("empty", 3, None)]
    df = spark.createDataFrame(rows, "g string, h int, v int")
    sets = [["g", "h"], ["g"], ["h"], []]
    got = merged_counts(distinct_bitmaps(df, by=["g", "h"], value="v"), by=["g", "h"], sets=sets).collect()
    want = {}
    for g, h, v in rows:
        for key in ((g, h, 0), (g, None, 1), (None, h, 2), (None, None, 3)):
            want.setdefault(key, set()).update([] if v is None else [v])
    assert {(r.g, r.h, r.grouping_id): r.n_distinct for r in got} == {k: len(v) for k, v in want.items()} and len(got) == len(want)


def test_merging_reads_bitmaps_only(spark, capsys):
    bitmaps = distinct_bitmaps(spark.range(1000).selectExpr("id % 3 as g", "id as v"), by=["g"], value="v")
    merged_counts(bitmaps, by=["g"], sets=[["g"], []]).explain()
    plan = capsys.readouterr().out
    assert "Range" not in plan and plan.count("bitmaps-") >= 1


def test_broken_text_is_kept_and_values_of_other_types_are_null(spark):
    texts = ['{"k": 1, "s": "x"}', '{"k": "no", "s": 2}', '{"k": ', None, "[1, 2]", "3", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = shredded(df, "t", {"k": ("$.k", "int"), "s": ("$.s", "string")})
    assert [(r.k, r.s, r.none) for r in got.selectExpr("i", "k", "s", "parsed is null as none").orderBy("i").collect()] == [(1, "x", False), (None, "2", False), (None, None, True), (None, None, True), (None, None, False), (None, None, False), (None, None, False)]
    rows = entries(got, "parsed").select("i", "pos", "key", F.expr("cast(value as string)").alias("v")).collect()
    assert sorted((r.i, r.key or "", r.v) for r in rows) == [(0, "k", "1"), (0, "s", "x"), (1, "k", "no"), (1, "s", "2"), (4, "", "1"), (4, "", "2")]
