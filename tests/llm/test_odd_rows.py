"""What each operator makes of null, empty, very long, repeated and clashing rows, as its docstring says."""

import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import _store, decontaminate, language_model, line_dup, near_dup, quality_model, quality_rules, repeats, sentence_pieces, sharding, surrogates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k % 977} and{k}" for k in range(30_000))
TEXTS = {1: None, 2: "", 3: " \n\t ", 4: "One line", None: "no id here at all", 5: LONG, 6: LONG, 7: "naïve ▁ text\n\nnaïve ﬁ 日本語 🎉\x00", 8: "a b c d e f g h " * 40}
ROWS = [*TEXTS.items(), (4, "One line")]
N = {i: len(WORD.findall(t or "")) for i, t in TEXTS.items()}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit("en"))
    clash = ("n", "pos", "kept", "size", "h", "row", "block", "a", "b", "part", "count", "grp", "label", "shard", "later", "roster")
    return df.select("*", *(F.lit(1).alias(c) for c in clash)).repartition(3).cache()


def results(df):
    rows = df.collect()
    assert len(rows) == len(ROWS)
    return {r.doc_id: r for r in rows}


def test_surrogates(docs):
    got = results(surrogates.pseudonymize(docs, b"key"))
    assert {i: r.text for i, r in got.items()} == TEXTS and all(r.n_entities == 0 and r.kinds == [] for r in got.values())


def test_decontamination(docs):
    tests = docs.where("doc_id in (1, 2, 4, 5)").select(F.col("doc_id").alias("item_id"), "text")
    got = results(decontaminate.flag(docs, tests))
    assert {i for i, r in got.items() if r.contaminated} == {5, 6} == {i for i, r in got.items() if not r.kept}
    assert all((r.item_id, r.n_hits > 0) == ((5, True) if i in (5, 6) else (None, False)) for i, r in got.items())


def test_sentence_pieces(spark, docs):
    got = results(sentence_pieces.encode(docs, sentence_pieces.read_model(spark)))
    assert {i: r.decoded for i, r in got.items()} == {i: t and t.replace("▁", " ") for i, t in TEXTS.items()}
    assert got[1].ids == got[2].ids == [] and all(r.parity and r.n_tokens == len(r.ids) for r in got.values())


def test_language_model(docs):
    got = results(language_model.score_texts(docs))
    assert {i: r.n_tokens for i, r in got.items()} == {i: n + 1 for i, n in N.items()}
    assert got[1].score == got[2].score == got[3].score < 0 and not got[None].held_out


def test_near_duplicates(docs):
    got = results(near_dup.near_duplicates(docs))
    want = {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), None: (1, None, True), 5: (59_996, 5, True), 6: (59_996, 5, False), 7: (3, 7, True), 8: (8, 8, True)}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == want


def test_quality_model(docs):
    got = results(quality_model.classify(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))))
    assert got[1].score == got[2].score and got[5].score == got[6].score and all(0 <= r.score <= 1 for r in got.values())
    assert not got[None].held_out
    none = results(quality_model.classify(docs, docs.where("false").select("doc_id", F.lit(1).alias("quality"))))
    assert {r.score for r in none.values()} == {0.5}


def test_quality_rules(docs):
    got = results(quality_rules.apply_rules(docs))
    assert {i: r.n_words for i, r in got.items()} == N and {i for i, r in got.items() if not r.base_failed} == {5, 6}
    assert got[8].n_repeat_words == 320 and not any(got[i].kept for i in (1, 2, 3, 4, 7, 8, None)) and got[5].kept == got[6].kept


def test_repeats(docs):
    got = results(repeats.drop_repeats(docs))
    gone = {5: N[5], 6: N[6], 8: 320}
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {i: (n, gone.get(i, 0)) for i, n in N.items()}
    assert got[4].text == "One line" and got[1].text == got[5].text == ""


def test_lines(docs):
    got = results(line_dup.drop_lines(docs, line_dup.bitmaps(docs, min_docs=2)))
    assert {i: (r.n_lines, r.n_dropped) for i, r in got.items()} == {i: ((t or "").count("\n") + 1, int(i in (5, 6))) for i, t in TEXTS.items()}
    assert got[5].text == got[1].text == "" and got[7].text == TEXTS[7] and got[4].row == 1


def test_shards(docs):
    rows = sharding.shard(docs, 4).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 16) for i, t in ROWS)
    by_text = {}
    for r in rows:
        by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in {r.shard for r in rows})


def test_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _store.shared_folder(Cluster)
