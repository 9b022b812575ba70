"""Shards against brute force, with and without rounds of refinement."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import sharding


def least_capacity(groups, shards):
    def fits(capacity):
        n, left = 0, 0
        for g in groups:
            n, left = (n, left - g) if g <= left else (n + 1, capacity - g)
        return n <= shards

    low, high = max(groups), sum(groups)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def sizes_of(spark, docs, shards=40):
    key = [F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), F.octet_length("text").alias("n")]
    groups = docs.groupBy(*key).agg(F.sum(F.octet_length("text") + 16).alias("size")).orderBy("h", "c", "n")
    got = sharding.shard(docs, shards).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(size) < shards
    return [r["size"] for r in groups.collect()], size


RNG = random.Random(11)
TABLES = {
    "mixed": ["x" * RNG.randrange(1, 400) + str(RNG.random()) for _ in range(1500)],
    "ties": [f"{k:06d}" for k in range(1500)],
    "dominant": ["x" * 20_000, *(f"{k:06d}" + "y" * RNG.randrange(40) for k in range(900))],
    "copies": [*["same text"] * 700, *(f"{k:06d}" + "y" * RNG.randrange(40) for k in range(900))],
    "few": ["a", "bb", "ccc", "a"],
}


@pytest.mark.parametrize("name", TABLES)
def test_capacity_is_least(spark, name):
    docs = spark.createDataFrame(list(enumerate(TABLES[name])), "doc_id long, text string")
    groups, size = sizes_of(spark, docs)
    assert max(size.values()) == least_capacity(groups, 40) and len(size) == min(40, len(groups))
    if name in ("dominant", "copies"):  # the others share what the large group leaves
        rest = sorted(size.values())[:-1]
        assert rest[1] > 0.4 * rest[-1]  # but for what stands before it


@pytest.mark.parametrize("name", TABLES)
def test_capacity_is_least_after_rounds_of_refinement(spark, monkeypatch, name):
    rounds = []
    look = sharding._Ends.look
    monkeypatch.setattr(sharding, "POINTS", 8)
    monkeypatch.setattr(sharding._Ends, "look", lambda self, *a: rounds.append(1) or look(self, *a))
    docs = spark.createDataFrame(list(enumerate(TABLES[name])), "doc_id long, text string")
    for shards in (3, 5):
        groups, size = sizes_of(spark, docs, shards)
        assert max(size.values()) == least_capacity(groups, shards)
    assert len(rounds) > 2 or name == "few"


def test_fifty_thousand_rows(spark, monkeypatch):
    rounds = []
    look = sharding._Ends.look
    monkeypatch.setattr(sharding._Ends, "look", lambda self, *a: rounds.append(len(a[2])) or look(self, *a))
    monkeypatch.setattr(sharding, "POINTS", 1 << 10)
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat("id", F.repeat(F.lit("z"), F.expr("int(pmod(hash(id), 900))"))).alias("text"))
    groups, size = sizes_of(spark, docs)
    assert max(size.values()) == least_capacity(groups, 40) and min(size.values()) > 0.98 * max(size.values())
    assert len(rounds) > 1 and max(rounds) <= 3 * 8 * 40**2


def test_even_runs_fit():
    rng = np.random.default_rng(4)
    for _ in range(300):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, rng.choice([3, 50, 900]), rng.integers(1, 80)))])
        total = int(at[-1])
        ends = sharding._Ends(total)
        ends.look([(0, total)], 1, at[1:], at[1:])
        shards = int(rng.integers(1, 12))
        capacity = least_capacity(np.diff(at).tolist(), shards)
        runs = ends.even(capacity, shards)
        assert len(runs) == shards and runs[-1] == at[-1] and set(runs) <= set(at.tolist())
        assert max(np.diff([0, *runs])) == capacity and min(np.diff([0, *runs])) >= 0
