"""Nearest neighbours against all pairs, and how much the index skips."""

import numpy as np
import pytest

from larkspur.operators.nearest import build_index, nearest

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    out = set()
    for q, v in asked:
        away = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 6), i) for i, w in rows if i != q)
        out |= {(q, n, i, d) for n, (d, i) in enumerate(away[:k], 1)}
    return out


def clustered(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 4, (12, width))
    return [(i, [round(float(x), 3) for x in middle[rng.integers(12)] + rng.normal(0, spread, width)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "block"), [(0.2, 40), (3.0, 32_768)])
def test_neighbours_equal_all_pairs(spark, spread, block):
    rows = clustered(1, 500, 6, spread)
    rows += [(500 + i, rows[3][1]) for i in range(90)]  # a vector that many rows have
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (990, None), (991, [float("nan")] * 6), (992, [None] * 6)], SCHEMA).repartition(4)
    index = build_index(df, cells=16, rings=4, block=block)
    got = nearest(df, index, k=4).collect()
    assert {(r.query_id, r["rank"], r.id, round(r.distance, 6)) for r in got} == brute(rows, rows, 4) and len(got) == 4 * len(rows)
    assert int(index.rings.blocks.sum()) > len(index.rings.size) or block > 500  # the hot ring is cut


def test_most_pairs_are_skipped_where_vectors_cluster(spark):
    rows = clustered(2, 1500, 8, 0.2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest(df.where("vec_id % 10 = 0"), build_index(df), k=5).select("query_id", "compared").distinct().collect()
    assert len(got) == 150
    assert 1 - sum(r.compared for r in got) / (150 * 1500) > 0.7


def test_few_rows_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = build_index(df)
    got = nearest(df, index, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in got) == [(1, 1, 2, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0)]
    assert nearest(df.where("false"), index).count() == 0
    assert nearest(df, build_index(df.where("false"))).count() == 0
    with pytest.raises(ValueError, match="1 to 2 components"):
        build_index(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0])], SCHEMA))
