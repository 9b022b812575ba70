"""The language model against brute-force counts and expectation-maximisation."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import _store, language_model

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(texts, rounds=12, deleted=10):
    """Scores by plain counting: see language_model for the model."""
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    out = {i: not held[i] and zlib.crc32(f"{i}deleted".encode()) % deleted == 0 for i in texts}

    def counts(ids):
        one, two = collections.Counter(), collections.Counter()
        for i in ids:
            one.update(tokens[i])
            two.update(zip([None, *tokens[i][:-1]], tokens[i], strict=True))
        return one, two, sum(one.values()), len(one)

    def estimates(model, before, token):
        one, two, n, v = model
        context = one[before]
        return [two[before, token] / max(context, 1), one[token] / max(n, 1), 1 / (v + 1)], min(int(math.log2(context + 1)), 23)

    kept = counts(i for i in texts if not held[i] and not out[i])
    events = [estimates(kept, a, b) for i in texts if out[i] for a, b in zip([None, *tokens[i][:-1]], tokens[i], strict=True)]
    weights = [[0.4, 0.5, 0.1] for _ in range(24)]
    weights[0] = [0.0, 0.9, 0.1]
    for _ in range(rounds):
        sums = [[0.0] * 3 for _ in range(24)]
        for p, bucket in events:
            mixed = [w * x for w, x in zip(weights[bucket], p, strict=True)]
            for k in range(3):
                sums[bucket][k] += mixed[k] / sum(mixed)
        weights = [[x / sum(s) for x in s] if sum(s) else w for s, w in zip(sums, weights, strict=True)]
    model = counts(i for i in texts if not held[i])

    def score(i):
        found = (estimates(model, a, b) for a, b in zip([None, *tokens[i][:-1]], tokens[i], strict=True))
        return sum(math.log10(sum(w * x for w, x in zip(weights[bucket], p, strict=True))) for p, bucket in found)

    return {i: score(i) for i in texts}, model[2]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()


@pytest.mark.parametrize(("block_bytes", "direct"), [(8 << 20, 1024), (20_000, 1024), (20_000, 1)])
def test_scores_equal_brute_force(docs, block_bytes, direct):
    want, n = expected({r.doc_id: r.text for r in docs.collect()})
    settings = language_model.Settings(block_bytes=block_bytes, direct_blocks=direct)
    got = language_model.score_texts(docs, settings=settings).collect()
    assert {r.doc_id for r in got} == set(want) and all(r.train_tokens == n for r in got)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-5, abs_tol=1e-4)


def test_rows_grow_less_than_with_the_square_of_the_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.substring("text", 1, 500).alias("text"))
    sizes, made = (8, 32, 128), []
    for n in sizes:
        blocks = docs.select((F.pmod(F.xxhash64("doc_id"), F.lit(n)) * 3).alias("block"), "text")
        answers, summed = language_model._in_two_steps(blocks, n.bit_length())
        made.append(answers.count() + summed.count())
    for a, b in ((0, 1), (1, 2)):
        assert made[b] / made[a] < (sizes[b] / sizes[a]) ** 1.6
    assert made[2] < 128 * (2 << (128).bit_length()) / 4  # rows that each block would send to each part


def test_sweep_removes_tables(spark, docs):
    language_model.score_texts(docs.limit(20)).collect()
    assert _store._tables and all(t in {r.tableName for r in spark.sql("SHOW TABLES").collect()} for t in _store._tables)
    names = list(_store._tables)
    assert _store.sweep(spark) > 0 and not _store._written
    assert not set(names) & {r.tableName for r in spark.sql("SHOW TABLES").collect()}
