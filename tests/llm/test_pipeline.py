"""The pipeline's stages against brute force written here, and on odd rows."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import quality_rules

DATA = "/root/testdata/sf0.001"
WORD, TOKEN, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\W_]+"), " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{k % 977} and{k}" for k in range(20_000))


def key(line):
    return line.translate(LOWER).strip(SPACE)


def without_common_lines(texts):
    docs = collections.Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    return {i: "\n".join(x for x in t.split("\n") if docs[key(x)] < 10) for i, t in texts.items()}


def one_of_each_group(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    least = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * max(len(sets[a] | sets[b]), 1)]
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: t for i, t in texts.items() if least[i] == i}


def overlaps(words, items):
    """Whether 13 words in a row agree with an item's in 11 places or more."""
    for item in items:
        for shift in range(13 - len(words), len(item) - 12):
            same = [item[k + shift] == w if 0 <= k + shift < len(item) else None for k, w in enumerate(words)]
            for k in range(len(words) - 12):
                part = same[k : k + 13]
                if None not in part and sum(part) >= 11:
                    return True
    return False


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage makes of all that the one before it kept."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), name)
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def texts_of(rows):
    return {i: r.text for i, r in rows.items()}


def test_quality_rules_stage(spark, stages):
    given = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for i, r in given.items():
        words = WORD.findall(r.text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = collections.Counter(windows)
        covered = {x for k, w in enumerate(windows) if often[w] > 1 for x in range(k, k + 8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert not (failed and i in stages[0])
        if not failed and len(words) < quality_rules.Rules().min_words:
            assert i in stages[0]
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(stages[0])) >= 0.95 * len(good) and all(stages[0][i] == given[i] for i in stages[0])


def test_line_stage(stages):
    want = without_common_lines(texts_of(stages[0]))
    assert texts_of(stages[1]) == want and all(r.n_chars == len(r.text) for r in stages[1].values())


def test_near_duplicate_stage(stages):
    assert texts_of(stages[2]) == one_of_each_group(texts_of(stages[1]))


def test_decontamination_stage(spark, stages):
    items = [TOKEN.findall(r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = texts_of(stages[2]), texts_of(stages[3])
    grams = {tuple(w[k : k + 4]) for w in items for k in range(len(w) - 3)}
    for i, t in before.items():
        words = TOKEN.findall(t.lower())
        # 11 of 13 words agree: so do some 4 in a row, and only around these it pays to look
        at = [k for k in range(len(words) - 3) if tuple(words[k : k + 4]) in grams]
        hit = any(overlaps(words[max(0, k - 12) : k + 16], items) for k in at)
        assert hit == (i not in after)
    assert len(after) < len(before)


def test_encoding_stage(stages):
    import sentencepiece

    from larkspur.llm.sentence_pieces import DEFAULT_MODEL

    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    assert set(stages[4]) == set(stages[3])
    for i, r in stages[4].items():
        assert r.ids == library.encode(stages[3][i].text) and r.n_tokens == len(r.ids) and r.parity and r.decoded == stages[3][i].text


CLASH = ("kept", "row", "n_words", "n_hits", "n_lines", "size", "h", "item_id", "contaminated", "th")
PROSE = "the cat of a man and the dog in the house that is for it was on the way to the town of the king"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (None, PROSE + " too"), (None, None), (5, LONG), (6, LONG), (7, PROSE.replace("cat", "naïve ﬁ 日本語 🎉"))]


def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


def ids(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_odd_rows(spark):
    docs = odd(spark, ODD)
    first = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert first.columns == docs.columns and ids(first) in (["4", "4", "5", "6", "7", "None"], ["4", "4", "7", "None"])
    second = corpus_pipeline.line_dedup(spark, docs, DATA)
    assert second.columns == docs.columns and ids(second) == ids(docs)
    assert {(r.doc_id, r.text) for r in second.collect()} == {(i, t or "") for i, t in ODD}
    third = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert third.columns == docs.columns and ids(third) == ["1", "2", "3", "4", "4", "5", "7", "None", "None"]
    fourth = corpus_pipeline.decontamination(spark, docs, DATA)
    assert fourth.columns == docs.columns and ids(fourth) == ids(docs)
    for stage in (first, second, third, fourth):
        assert all(r[c] == f"own {c}" for r in stage.collect() for c in CLASH)
    last = corpus_pipeline.encoding(spark, docs, DATA).collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in last) == collections.Counter(ODD)
    assert all(r.n_tokens == 0 for r in last if not r.decoded)


def test_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, []), DATA).collect() == []
