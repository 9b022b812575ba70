"""Hard negatives and vector codes against loops in plain Python, and against SQL."""

import math
import random

import pytest

from larkspur.llm.hard_negatives import hard_negatives

LONG = "vec_id long, label long, embedding array<float>"


def mined(rows, k=5):
    """The contract of op11 in plain Python: rows of (id, label, vector)."""
    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, own, u in (r for r in ok if r[0] % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(u, v, strict=False)), i, l) for i, l, v in ok if i != a)
        for s, p, _ in [r for r in scored if r[2] == own][:k]:
            hard = [(t, i) for t, i, l in scored if l != own and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(a, p, n, i, -s, -t) for n, (t, i) in enumerate(hard, 1)}
    return out


def draw_rows(seed, n, width, labels):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = draw.choice([0, *range(labels)])
        rows.append((i * 10, label, [float(round(m + draw.gauss(0, 0.6), 2)) for m in middle[draw.choice([label, 0])]]))
    return rows


@pytest.mark.parametrize("block", [7, 65_536])
def test_hard_negatives_equal_a_loop(spark, block):
    rows = draw_rows(3, 240, 6, 4)
    rows += [(100 * k + 1, 2, [0.5] * 6) for k in range(20)] + [(100 * k + 2, 3, [0.5] * 6) for k in range(20)]  # ties
    odd = [(3, None, [1.0] * 6), (None, 1, [1.0] * 6), (4, 1, None), (5, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (6, 1, [math.nan] * 6), (7, 1, [math.inf] * 6), (8, 1, [2.0, 1.0]), (9, 1, [])]
    df = spark.createDataFrame(rows + odd, LONG)
    df = df.selectExpr("*", "1 as block", "2 as side", "3 as anchor", "4 as positives")  # names that the operator uses
    got = hard_negatives(df, anchors="vec_id % 100 = 0", block=block).collect()
    want = mined([(i, l, v and [x if x is None else float(spark_float(x)) for x in v]) for i, l, v in rows + odd])
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 200


def spark_float(x):
    import numpy as np

    return np.float32(x)


def test_hard_negatives_of_repeated_and_no_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [9.0, 9.0]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.0]), (2, 2, [0.9, 0.0])]
    got = hard_negatives(spark.createDataFrame(rows, LONG), anchors="vec_id = 0").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 58880)]
    assert hard_negatives(spark.createDataFrame(rows, LONG).where("false"), anchors="vec_id = 0").count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**21
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 2, [big, 2.0 + 1 / 256]), (3, 2, [big, 2.0])]
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), anchors="vec_id = 0").collect()
    top = (1 << 29) ** 2 + 256 * 768
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, top, top - 256 * 255), (0, 1, 2, 3, top, top - 256 * 256)]


def coded(rows, parts, entries, rounds):
    """The contract of op13 in plain Python: rows of (id, whole numbers) in order of their ids."""
    cut = {i: [v[k * len(v) // parts : (k + 1) * len(v) // parts] for k in range(parts)] for i, v in rows}
    books = [[cut[i][p] for i, _ in rows[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = {i: [min(range(len(books[p])), key=lambda e, p=p, c=c: (away(c[p], books[p][e]), e)) for p in range(parts)] for i, c in cut.items()}
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if own := [cut[i][p] for i in cut if codes[i][p] == e]:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return {i: (codes[i], sum(away(c[p], books[p][codes[i][p]]) for p in range(parts))) for i, c in cut.items()}, books


def test_codes_equal_a_loop(spark):
    from larkspur.llm.vector_codes import compress

    draw = random.Random(8)
    rows = [(i, [draw.choice([-1, 0, 1, draw.randrange(-9, 9)]) + draw.choice([-40, 0, 40]) for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, list(rows[i % 7][1])) for i in range(60)]
    odd = [(900, None), (901, [1.0, None] * 6), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11)]
    df = spark.createDataFrame([(i, 1, v and [x if x is None else x / 4 for x in v]) for i, v in rows + odd], LONG)
    df = df.selectExpr("*", "1 as codes", "2 as row", "3 as lower", "4 as v").repartition(5)
    for entries, rounds in ((16, 2), (16, 4), (1, 1), (3, 2)):
        got, books = compress(df, parts=4, entries=entries, rounds=rounds, groups=5, scale=4)
        want, want_books = coded(rows, 4, entries, rounds)
        assert {r.vec_id: (list(r.codes), r.error) for r in got.collect()} == want and books.tolist() == want_books
    assert got.columns == ["vec_id", "label", "embedding", "row", "lower", "v", "codes", "error"]


def test_bounds_spare_distances_and_change_nothing():
    import numpy as np

    from larkspur.llm.vector_codes import Codebooks, assign, grouped

    rng = np.random.default_rng(4)
    x = (rng.integers(-3, 4, (800, 1, 1)) * 60 + rng.integers(-9, 9, (800, 3, 4))).astype(np.int64)
    entries = x[:32].transpose(1, 0, 2).copy()
    books = Codebooks(entries, grouped(entries, 6))
    codes, lower, _, every = assign(x, books)
    spared = []
    for step in (0, 1, 3, 9):
        moved = Codebooks(books.entries + rng.integers(-step, step + 1, entries.shape), books.groups)
        codes, lower, nearest, n = assign(x, moved, codes, lower, moved.moves(books))
        plain, _, plain_nearest, _ = assign(x, moved)
        assert (codes == plain).all() and (nearest == plain_nearest).all()
        spared.append(1 - n / every)
        books = moved
    assert spared[0] > 0.5 and spared[1] > 0.3, spared


def test_codes_of_few_uneven_and_large_vectors(spark):
    from larkspur.llm.vector_codes import compress

    rows = [(2, None, [1.0, 2.0, 3.0]), (1, None, [2.0**33]), (None, None, []), (2, None, [1.0, 2.0, 3.0])]
    got, books = compress(spark.createDataFrame(rows, LONG), parts=2, rounds=1, scale=1)
    assert books.shape == (2, 4, 2) and books[0].tolist() == [[2**33, 0], [1, 2], [1, 2], [0, 0]]
    assert sorted((str(r.vec_id), list(r.codes), r.error) for r in got.collect()) == [("1", [0, 0], 0), ("2", [1, 1], 0), ("2", [1, 1], 0), ("None", [3, 0], 0)]
    none, books = compress(spark.createDataFrame(rows, LONG).where("false"))
    assert none.count() == 0 and books.size == 0
