"""Quality rules and classifier: distances, verdicts, ridge and calibration against plain numpy, and held-out labels."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def js_distance(p, q):
    total = 0.0
    for a, b in zip(p, q, strict=True):
        total += a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
        total += b * math.log2(2 * b / (a + b)) if b > 0 else 0.0
    return math.sqrt(max(total / 2, 0.0))


def shares(text, reference):
    words, n = WORD.findall(text), len(text)
    found = [len(re.findall(p, text)) for p in (r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", quality_rules.MARKS)]
    chars = sum(map(len, words))
    count = collections.Counter(w.lower() for w in words)
    common = [count[w] / len(words) for w in reference.words]
    return [x / n for x in (chars - sum(found), n - chars, *found)], [*common, max(1 - sum(common), 0.0)]


def test_distances_and_verdicts(spark):
    rules = quality_rules.Rules()
    got = quality_rules.apply_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    judged = 0
    for r in got:
        if r.n_words < rules.min_words:
            assert r.class_distance is None and r.word_distance is None and r.kept == (not r.base_failed)
            continue
        ref = rules.references[r.lang]
        classes, words = shares(r.text, ref)
        a, b = js_distance(classes, ref.classes), js_distance(words, [*ref.words.values(), 1 - sum(ref.words.values())])
        assert math.isclose(r.class_distance, a, abs_tol=1e-9) and math.isclose(r.word_distance, b, abs_tol=1e-9)
        limit = rules.word_limit[0] + rules.word_limit[1] / math.sqrt(r.n_words)
        wordless, least = ref.wordless()
        limit = min(limit, rules.wordless_part * wordless) if r.n_words >= least else limit
        over = a > rules.class_limit[0] + rules.class_limit[1] / math.sqrt(r.n_words) or b > limit
        assert r.kept == (not r.base_failed and not over)
        judged += 1
    assert judged > 100


def test_measured_rules_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    docs = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).cache()
    rules = quality_rules.measured(docs.where("quality = 1 and not held"))
    for lang, ref in quality_rules.REFERENCES.items():
        assert max(abs(a - b) for a, b in zip(rules.references[lang].classes, ref.classes, strict=True)) < 0.01
        assert len(rules.references[lang].words) == 12 and len(set(rules.references[lang].words) & set(ref.words)) >= 8
    rows = quality_rules.apply_rules(docs.where("held"), rules).collect()
    good, bad = ([r.kept for r in rows if r.quality == q and not r.base_failed] for q in (1, 0))  # the base rules are given
    print(f"kept of held-out rows: {sum(good)} of {len(good)} good, {sum(bad)} of {len(bad)} bad")
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)
    assert quality_rules.measured(docs.where("false")) == quality_rules.Rules()


def test_query_on_held_out_labels(spark):
    from larkspur.llm.queries import op7_quality_rules

    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    rows = op7_quality_rules(spark, data).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    print(f"the query keeps of held-out rows {sum(good)} of {len(good)} good, {sum(bad)} of {len(bad)} bad")
    assert sum(good) >= 0.998 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_a_filter_on_the_verdict_costs_no_more_than_the_verdict(spark):
    import time

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def took(condition):
        began = time.time()
        n = quality_rules.apply_rules(docs).where(condition).select("doc_id", "kept").collect()
        return time.time() - began, n

    took("true")
    plain, rows = took("true")
    filtered, kept = took("kept")
    assert sorted(kept) == sorted(r for r in rows if r.kept) and 0 < len(kept) < len(rows)
    assert filtered <= 2 * plain + 1, (filtered, plain)


def test_rules_from_few_and_no_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    few, many = quality_rules.labelled_rules(docs, labels, most=5), quality_rules.labelled_rules(docs, labels)
    assert 0 < len(few.references) <= 4 == len(many.references) and few.class_limit[0] > many.class_limit[0] - 0.05
    odd = docs.selectExpr("doc_id", "cast(null as string) as text", "lang")
    assert quality_rules.labelled_rules(docs, labels.where("quality > 1")) == quality_rules.Rules() == quality_rules.labelled_rules(odd, labels)


def test_statistics_by_hand():
    text = "The cat sat.\nThe cat sat.\nIT is 42 of #1!"
    data = np.frombuffer((text + "é").encode(), np.uint8)
    got = dict(zip(quality_model.STATISTICS, quality_model.statistics(data, np.array([0, len(text), len(data)]))[0], strict=True))
    words = text.split()
    assert math.isclose(got["words"], math.log1p(11)) and math.isclose(got["distinct"], len(set(words)) / 11)
    assert math.isclose(got["word_bytes"], sum(map(len, words)) / 11) and math.isclose(got["capitals"], 4 / len(text))
    assert math.isclose(got["digits"], 3 / len(text)) and math.isclose(got["lines"], 3 / 11) and math.isclose(got["line_repeats"], 1 / 3)


def test_ridge_and_calibration_equal_plain_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality_model.STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=400) > 0.5).astype(int)
    fold = rng.integers(0, quality_model.FOLDS, 400)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "x array<double>, y int, fold int").repartition(7)
    model = quality_model.fit(rows)
    z = np.concatenate([np.sqrt(2 / 256) * np.cos(np.clip((x - x.mean(0)) / x.std(0), -8, 8) @ model.weights + model.phase), np.ones((400, 1))], 1)

    def ridge(own):
        a = z[own].T @ z[own] + 1e-3 * own.sum() / 256 * np.eye(257)
        return np.linalg.solve(a, z[own].T @ y[own])

    assert np.allclose(model.ridge, ridge(np.ones(400, bool)), atol=1e-6)
    ridges = [ridge(fold != k) for k in range(quality_model.FOLDS)]
    raw = np.array([z[k] @ ridges[fold[k]] for k in range(400)])
    bins = np.clip((raw + 0.5) / 2 * quality_model.BINS, 0, quality_model.BINS - 1).astype(int)
    # isotonic levels by the max-min formula over all runs of bins
    at = np.unique(bins)
    n, s = (np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(at, bins), w, len(at)))]) for w in (None, y))
    size = len(at)
    mean = np.array([[(s[j + 1] - s[i]) / (n[j + 1] - n[i]) if j >= i else np.inf for j in range(size)] for i in range(size)])
    level = [max(mean[i, k:].min() for i in range(k + 1)) for k in range(size)]
    assert np.allclose(model.levels[at], level, atol=1e-9) and (np.diff(model.levels) >= -1e-12).all()


@pytest.mark.parametrize("folds", [[0], [0, 0, 0], [1, 1, 4]])
def test_few_training_rows(spark, folds):
    rows = spark.createDataFrame([([float(k)] * len(quality_model.STATISTICS), k % 2, f) for k, f in enumerate(folds)], "x array<double>, y int, fold int")
    levels = quality_model.fit(rows).levels
    assert len(levels) == quality_model.BINS and (levels >= 0).all() and (levels <= 1).all()


def test_scores_are_calibrated_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.classify(docs.join(labels, "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").collect()
    score, truth = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert np.mean((score - truth) ** 2) < 0.05 and abs(score.mean() - truth.mean()) < 0.03


def test_hits_of_repeated_rows_count_once(spark):
    words = " ".join(f"w{k}" for k in range(20))
    tests = spark.createDataFrame([(9, words)], "item_id long, text string")
    one = decontaminate.flag(spark.createDataFrame([(1, words)], "doc_id long, text string"), tests).first()
    docs = spark.createDataFrame([(1, words), (1, words), (1, words + " more"), (2, words)], "doc_id long, text string")
    for seeds in (decontaminate.Seeds(), decontaminate.Seeds(broadcast_rows=0)):
        got = decontaminate.flag(docs, tests, seeds).collect()
        assert [r.n_hits for r in got] == [one.n_hits] * 4 and one.n_hits == 2 * 13 and all(r.item_id == 9 for r in got)


def test_short_items_match_whole_and_unchanged_only(spark):
    item = [f"w{k}" for k in range(10)]
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "w0 w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    changed = [*item[:4], "x", *item[5:]]
    given = [" ".join(["a", "b", *item, "c"]), " ".join(item), " ".join(item[:9]), " ".join(["a", *changed, "b"]), " ".join(item[1:] + ["z"] * 9)]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for seeds in (decontaminate.Seeds(), decontaminate.Seeds(broadcast_rows=0)):
        got = {r.doc_id: r.item_id for r in decontaminate.flag(docs, tests, seeds).collect()}
        assert got == {0: 1, 1: 1, 2: None, 3: None, 4: None}


def test_templates_are_joined_not_paired(spark, capsys):
    """Items that share a template: the join of choices finds what laying side by side finds, and makes no row for each pair."""
    import random

    draw = random.Random(12)
    word = lambda: f"w{draw.randrange(40)}"
    template = [f"t{k}" for k in range(9)]
    items = [[*(word() for _ in range(draw.randrange(6))), *template, *(word() for _ in range(draw.randrange(8)))] for _ in range(90)]
    items += [template, template[:8], [*template, "x"], [f"u{k}" for k in range(30)]]

    def varied(tokens):
        out = list(tokens)
        for _ in range(draw.randrange(4)):
            out[draw.randrange(len(out))] = word()
        return [*(word() for _ in range(draw.randrange(9))), *out, *(word() for _ in range(draw.randrange(9)))]

    texts = [varied(draw.choice(items)) for _ in range(160)] + [template, template[:8], [*template, "x"], [f"u{k}" for k in range(6, 25)], [word() for _ in range(40)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = []
    for seeds in (decontaminate.Seeds(crowd=10**6), decontaminate.Seeds(crowd=4), decontaminate.Seeds(crowd=4, broadcast_rows=0)):
        found.append({r.doc_id: (r.n_hits, r.item_id) for r in decontaminate.flag(docs, tests, seeds).collect()})
    assert found[0] == found[1] == found[2]
    assert 40 < sum(n > 0 for n, _ in found[0].values()) < len(texts) - 10
