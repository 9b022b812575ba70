"""Large groups of near copies: no link is lost, and no step returns more rows than it reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import near_dup


def copies(n, seed, words=100, most=4):
    """Texts that are one text with some words replaced: most pairs are between 0.6 and 0.9 alike."""
    rng = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for k in rng.sample(range(words), rng.randint(1, most)):
            text[k] = f"y{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def expected(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    number = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    matrix = np.zeros((len(sets), len(number)), np.float32)
    for k, s in enumerate(sets):
        matrix[k, [number[x] for x in s]] = 1
    both, size = matrix @ matrix.T, matrix.sum(1)
    linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    least = np.arange(len(sets))
    while True:
        new = np.array([least[row].min() for row in linked])
        if (new == least).all():
            return least.tolist(), linked
        least = new


@pytest.mark.parametrize(("shingles", "sketches"), [(1 << 21, 4096), (6_000, 64)])
def test_large_groups_of_near_copies(spark, monkeypatch, shingles, sketches):
    monkeypatch.setattr(near_dup, "SHINGLES", shingles)
    monkeypatch.setattr(near_dup, "SKETCHES", sketches)
    n = 2000 if shingles > 6_000 else 600
    texts = copies(n // 2, 1) + copies(n // 2, 2, most=8)
    random.Random(3).shuffle(texts)
    want, linked = expected(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(n)] == want
    if n == 2000:
        assert linked.sum() > 20 * n and len(set(want)) > 200  # both: many links, and many near misses


def test_blocks_return_a_forest(spark):
    texts = copies(300, 5, most=2)
    rows = [(k % 2, 0, 0, 1, k, k, 96, t) for k, t in enumerate(texts)]
    schema = "grp long, slice int, chunk int, outlier int, doc long, label long, n long, payload string"
    edges = near_dup._in_blocks(spark.createDataFrame(rows, schema), near_dup._Sets, within=True).collect()
    assert len({(r.a, r.b) for r in edges}) == len(edges) <= 298
    assert all((r.a - r.b) % 2 == 0 and r.a < r.b for r in edges)


def test_a_block_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_blocks_return_a_forest(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_a_long_chain_and_a_hub(spark):
    chain, hub = [(k, k + 1) for k in range(100)], [(1000, k) for k in range(1001, 1400)]
    got = near_dup.components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")).collect()
    want = {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(1000, 1400), 1000)}
    assert len(got) == len(want) and {r.doc_id: r.component for r in got} == want


def test_one_id_with_two_texts_links_what_either_resembles(spark):
    a, b = copies(2, 8, most=1), copies(2, 9, most=1)
    rows = [(5, a[0]), (5, b[0]), (9, a[1]), (7, b[1]), (9, a[1]), (3, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("grp", F.lit(1)))
    found = sorted((r.doc_id, r.component_id, r.kept) for r in got.collect())
    assert found == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False)]
