"""Running sums over bins, inequality joins and sweeps against loops, and the plans they make."""

import random

import pytest

from larkspur.operators.running import merged_spans, open_spans, running_sums, smaller_sums


def rows_of(seed, n):
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "b", None]), draw.choice([None, 7, *range(40)]), draw.choice([None, *range(9)])) for _ in range(n)]


@pytest.mark.parametrize("bins", [1, 3, 50])
def test_smaller_sums_equal_all_pairs(spark, bins):
    lefts, rights = rows_of(1, 150), rows_of(2, 200)
    left = spark.createDataFrame([(*r, 1, k) for k, r in enumerate(lefts)], "g string, x int, v int, n_smaller int, id int")
    right = spark.createDataFrame(rights, "g string, x int, v int")
    want = {}
    for k, (g, x, _) in enumerate(lefts):
        below = [v for h, y, v in rights if None not in (g, x, h, y) and g == h and y < x]
        some = [v for v in below if v is not None]
        want[k] = (len(below), float(sum(some)) if some else None)
    got = smaller_sums(left, right, by=["g"], on="x", value="v", bins=bins)
    assert got.columns == ["g", "x", "v", "id", "n_smaller", "sum_smaller"]
    rows = got.collect()
    assert {r.id: (r.n_smaller, r.sum_smaller) for r in rows} == want and len(rows) == len(lefts)
    assert smaller_sums(left, right.where("false"), by=["g"], on="x", value="v", bins=bins).where("n_smaller > 0 or sum_smaller is not null").count() == 0
    assert smaller_sums(left.where("false"), right, by=["g"], on="x", value="v", bins=bins).count() == 0


def test_a_hot_place_and_a_hot_group_are_spread(spark, capsys):
    # a third of all rows at one place, nearly all in one group
    df = spark.range(30_000).selectExpr("if(id % 50 = 0, 'few', 'many') as g", "if(id % 3 = 0, 100, id) as x", "1 as v")
    points = df.groupBy("g", "x").count()
    binned = running_sums(points, by=["g"], on="x", sums=["count"], bins=16)
    found = smaller_sums(df, df, by=["g"], on="x", value="v", bins=16)
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan
    top = found.where("g = 'many'").orderBy("n_smaller", ascending=False).first()
    assert top.n_smaller == df.where(f"g = 'many' and x < {top.x}").count() == top.sum_smaller
    sizes = [r["count"] for r in points.repartitionByRange(16, "g", "x").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16
    assert binned.where("count_before is null").count() == 2


@pytest.mark.parametrize("bins", [1, 4])
def test_sweeps_equal_loops(spark, bins, capsys):
    draw = random.Random(3)
    spans = [(draw.choice(["a", "b"]), s := draw.randrange(60), s + draw.choice([-1, 0, 1, 2, 5])) for _ in range(40)] + [(None, 1, 2), ("a", None, 2), ("a", 1, None)]
    df = spark.createDataFrame(spans, "g string, since int, until int")
    valid = [s for s in spans if None not in s and s[1] < s[2]]
    steps = open_spans(df, by=["g"], since="since", until="until", bins=bins)
    got = {(r.g, r.at): r.n_open for r in steps.collect()}
    assert got == {(g, t): sum(h == g and a <= t < b for h, a, b in valid) for g, *ends in valid for t in ends}
    want = set()
    for g in "ab":
        times = sorted({t for h, a, b in valid if h == g for t in range(a, b)})
        runs = [t for t in times if t - 1 not in times]
        want |= {(g, t, next(e for e in range(t, 99) if e not in times)) for t in runs}
    merged = merged_spans(df, by=["g"], since="since", until="until", bins=bins)
    assert set(map(tuple, merged.select("g", "since", "until").collect())) == want
    alone = open_spans(df, by=[], since="since", until="until", bins=bins)
    alone.explain()
    assert {r.at: r.n_open for r in alone.collect()} == {t: sum(a <= t < b for _, a, b in [s for s in spans if None not in s[1:] and s[1] < s[2]]) for _, *e in [s for s in spans if None not in s[1:] and s[1] < s[2]] for t in e}
