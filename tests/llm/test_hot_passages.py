"""Passages that all documents hold, and anchors too frequent for one task."""

import collections
import random

import pyarrow as pa
import pytest

from larkspur.llm import repeats


@pytest.mark.parametrize(("hot", "direct"), [(1 << 16, 1 << 32), (5, 1 << 32), (1 << 16, 0), (5, 0)])
def test_a_passage_that_every_task_holds(spark, monkeypatch, hot, direct):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    short = [f"s{k}" for k in range(30)]  # its anchors are hot, but no window lies in it
    texts = {}
    for i in range(300):
        own = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 90))]
        at = rng.randrange(len(own))
        texts[i] = own[:at] + (passage if i % 3 else short) + own[at:]
    often = collections.Counter(tuple(w[k : k + 35]) for w in texts.values() for k in range(len(w) - 34))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(40)
    for r in repeats.drop_repeats(docs, direct_bytes=direct).collect():
        w = texts[r.doc_id]
        gone = {x for k in range(len(w) - 34) if often[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        assert (r.n_words, r.n_removed) == (len(w), len(gone)) and r.text == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (len(gone) >= 60) == bool(r.doc_id % 3)


def test_a_bounded_number_of_equal_windows_is_held(monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 8)
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("mask", pa.int32()), ("windows", pa.binary())])
    same, other = (5).to_bytes(8, "little"), (6).to_bytes(8, "little")
    rows = [(1, k, 0, 3, 0, same) for k in range(100)] + [(2, 100 + k, 0, 3, 0, same if k else other) for k in range(20)] + [(3, 200, 0, 3, 0, same), (4, 201, 0, 3, 1, b"")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 3]), schema.types, strict=True)], schema=schema) for k in range(0, len(rows), 3)]
    out = [b.column("doc_id").to_pylist() for b in repeats._answer(iter(batches))]
    assert {i for b in out for i in b} == {*range(100), *range(101, 120), 201} and max(map(len, out)) <= 20


def test_dealt_slices_give_what_broadcast_bits_give(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "one two"), (2, "one two")], "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(odd)
    got = [sorted(map(repr, repeats.drop_repeats(docs, direct_bytes=d).collect())) for d in (1 << 32, 0)]
    assert got[0] == got[1] and len(got[0]) == docs.count()
    assert repeats.drop_repeats(docs.where("false"), direct_bytes=-1).count() == 0


def test_share_of_windows_sent_stays_as_text_and_sketch_grow(spark):
    """A hundred times the text with a hundred times the counters sends the same share of windows that are single."""
    rng = random.Random(5)
    share = []
    for n in (4, 400):
        texts = [(i, " ".join(f"w{rng.randrange(10**12)}" for _ in range(400))) for i in range(n)]
        docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "xxhash64(text) as text_hash").repartition(4)
        total = sum(len(t) for _, t in texts)
        dealt = repeats.Dealt(block_bytes=max(1, total // 8), slice_bits=12, counter_bits=int(total / 8).bit_length())
        runs = repeats.dealt_windows(docs, dealt, total).collect()
        share.append(sum(len(r.windows) // 8 for r in runs) / (n * 366))
    assert share[1] < 0.15 and share[1] < share[0] + 0.1, share
    assert repeats.Dealt.of(1 << 33).counter_bits == 31 and repeats.Dealt.of(1 << 43).counter_bits == 41
    for total in (1 << 33, 1 << 37, 1 << 40, 1 << 43):
        d = repeats.Dealt.of(total)
        pairs = (total / d.block_bytes) * (2 << (d.counter_bits - d.slice_bits))
        assert pairs <= 2e10 and d.slice_bits <= 27
