"""Bigram language model with deleted interpolation (Jelinek and Mercer).

The probability of a token after a context mixes the maximum-likelihood bigram and unigram estimates and a
uniform one; the weights depend on how often the context was seen, in buckets of powers of two, and are
learned by expectation-maximisation on a part of the training documents (about one in ``deleted``)
whose counts are left out of the estimates meanwhile.  The final estimates count all training documents.

Texts are dealt into blocks of about ``block_bytes``, written once as a table bucketed by block.  A
block sends each of its distinct words and bigrams once, with its count, to the part of the hash space
that adds these up, and gets the corpus counts back in the same order; then it scores its own texts.  So no
word's rows gather anywhere, however frequent it is, and no vocabulary is broadcast or collected.  N-grams are
told apart by 64-bit hashes.

A row goes from each block to each part, and both grow with the input.  From ``direct_blocks`` blocks on, the rows
would be the square of their number: then blocks send to few coarse parts, where those of one group of blocks
are merged, and the merged rows go on to the fine parts and back, about ``blocks ** 1.5`` rows in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sql import text_of
from ._store import bucketed, stored
from ._text import U, join_hashes, seeded, texts_of, words_of

END = seeded(77)  # the end of a text, and the context of its first word
KEPT, DELETED, TEST, MERGED = 0, 1, 2, 3  # of a block; MERGED: of a group of blocks, with counts of both sorts
CONTEXTS = 24  # buckets of context frequency
MOST_TASKS = 20_000  # of a shuffle, however large the input


@dataclass(frozen=True)
class Settings:
    block_bytes: int = 8 << 20
    deleted: int = 10
    rounds: int = 12
    direct_blocks: int = 1024
    task_bytes: int = 16 << 20  # of text for each task that adds counts up


@dataclass
class _Block:
    """The tokens of a block's texts: hashes of token and bigram, and where each text's tokens begin."""

    token: np.ndarray
    context: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> _Block:
        words = words_of(*texts_of(column), lower=True)
        n = words.count
        first = words.first + np.arange(len(n) + 1)
        token = np.full(first[-1], END)
        token[np.arange(len(words.start)) + words.text_of_word()] = words.hashes()
        context = np.roll(token, 1)
        context[first[:-1]] = END
        return cls(token, context, first)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        return self.token, join_hashes(self.context, self.token)


def _parts(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """The parts of the hash space that sorted hashes fall in: number of the part, first hash, end."""
    part = hashes >> U(64 - bits)
    cut = np.flatnonzero(np.diff(part, prepend=part[:1] + U(1), append=part[-1:] + U(1))).tolist()
    yield from ((int(part[a]), a, b) for a, b in zip(cut[:-1], cut[1:], strict=True))


_COUNTED = {"part": pa.int64(), "block": pa.int64(), "kind": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}
_ANSWERS = {"part": pa.int64(), "block": pa.int64(), "trained": pa.binary(), "kept": pa.binary()}
_TOTALS = dict.fromkeys(("n_trained", "v_trained", "n_kept", "v_kept"), pa.int64())


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table({c: pa.array(v, t) for (c, t), v in zip(schema.items(), columns, strict=True)})


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'binary' if t == pa.binary() else 'long'}" for c, t in schema.items())


def _counted(blocks: DataFrame, bits: int) -> DataFrame:
    """(part, block, kind, hashes, counts): each block's distinct grams in order, cut at the parts' borders.

    Parts from 0 on are of words, from ``1 << bits`` on of bigrams.
    """

    def count(key: tuple, table: pa.Table) -> pa.Table:
        block, rows = key[0].as_py(), []
        for order, grams in enumerate(_Block.of(table.column("text")).grams()):
            distinct, times = np.unique(grams, return_counts=True)
            for k, a, b in _parts(distinct, bits):
                counts = times[a:b].astype(np.uint32).tobytes()
                rows.append(((order << bits) + k, block, block % 3, distinct[a:b].tobytes(), counts))
        return _table(_COUNTED, rows)

    return blocks.groupBy("block").applyInArrow(count, _ddl(_COUNTED))


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct grams of rows of one part, their counts (trained, kept), and where each row's grams are among them."""
    kind = table.column("kind").to_numpy()
    hashes = [np.frombuffer(x, U) for x in table.column("hashes").to_pylist()]
    size = np.array([len(x) for x in hashes])
    raw = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
    times = np.concatenate([x[:n] for x, n in zip(raw, size, strict=True)]).astype(float)
    kept = np.concatenate([x[-n:] for x, n in zip(raw, size, strict=True)]).astype(float)  # the same but for MERGED rows
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    of = np.repeat(kind, size)
    trained = np.bincount(which, times * (of != TEST), len(distinct)).astype(np.uint64)
    kept = np.bincount(which, kept * ((of == KEPT) | (of == MERGED)), len(distinct)).astype(np.uint64)
    ends = np.cumsum(size)
    return distinct, trained, kept, [which[b - n : b] for b, n in zip(ends, size, strict=True)]


def _answered(part: int, table: pa.Table, trained: np.ndarray, kept: np.ndarray, spans: list[np.ndarray]) -> list[tuple]:
    """The counts of each row's grams in its own order; those without the deleted texts only where they are asked."""
    blocks, kinds = table.column("block").to_pylist(), table.column("kind").to_pylist()
    return [(part, block, trained[x].tobytes(), kept[x].tobytes() if kind in (DELETED, MERGED) else b"") for block, kind, x in zip(blocks, kinds, spans, strict=True)]


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """The corpus counts of one part's grams, for each block in its own order; the row of block -1 has the totals."""
    _, trained, kept, spans = _sums(table)
    rows = _answered(key[0].as_py(), table, trained, kept, spans)
    totals = tuple(int(x) for x in (trained.sum(), (trained > 0).sum(), kept.sum(), (kept > 0).sum()))
    return _table(_ANSWERS | _TOTALS, [*((*r, None, None, None, None) for r in rows), (key[0].as_py(), -1, b"", b"", *totals)])


def _answers(counted: DataFrame, tasks: int) -> DataFrame:
    # a task takes its parts one after the other and holds one at a time
    dealt = counted.repartition(tasks, "part")
    return stored(dealt.groupBy("part").applyInArrow(_added, _ddl(_ANSWERS | _TOTALS)), "counts")


def _in_two_steps(blocks: DataFrame, bits: int, tasks: int = 32) -> tuple[DataFrame, DataFrame]:
    """Answers for each block, and those for groups of blocks, which have the totals."""
    coarse = bits // 2
    group = F.expr(f"block div {3 << coarse}L").alias("grp")
    counted = stored(_counted(blocks, coarse).withColumn("grp", group), "grams")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        order = key[0].as_py() >> coarse
        distinct, trained, kept, _ = _sums(table)
        rows = []
        for k, a, b in _parts(distinct, bits):
            counts = np.concatenate([trained[a:b], kept[a:b]]).astype(np.uint32).tobytes()
            rows.append(((order << bits) + k, key[1].as_py(), MERGED, distinct[a:b].tobytes(), counts))
        return _table(_COUNTED, rows)

    def spread(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        _, _, _, spans = _sums(table)
        order = np.argsort(found.column("fine").to_numpy())
        trained, kept = (np.frombuffer(b"".join(np.array(found.column(c).to_pylist(), object)[order]), U) for c in ("trained", "kept"))
        return _table(_ANSWERS, _answered(key[0].as_py(), table, trained, kept, spans))

    merged = counted.groupBy("part", "grp").applyInArrow(merge, _ddl(_COUNTED))
    of_groups = _answers(merged, tasks)
    back = of_groups.where("block >= 0").select(F.expr(f"shiftright(part, {bits - coarse})").alias("part"), F.col("block").alias("grp"), F.col("part").alias("fine"), "trained", "kept")
    both = counted.groupBy("part", "grp").cogroup(back.groupBy("part", "grp"))
    return stored(both.applyInArrow(spread, _ddl(_ANSWERS)), "counts"), of_groups


def _looked_up(block: _Block, answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the corpus counts of itself, its context and its bigram."""
    order = np.argsort(answers.column("part").to_numpy())
    found = answers.column(column).to_pylist()
    counts = np.frombuffer(b"".join(found[k] for k in order), np.uint64)
    token, which = np.unique(block.token, return_inverse=True)
    context = counts[: len(token)][np.searchsorted(token, block.context)]
    _, pair = np.unique(block.grams()[1], return_inverse=True)
    return counts[: len(token)][which], context, counts[len(token) :][pair]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context.astype(float) + 1), CONTEXTS - 1).astype(np.int64)


def _estimates(counts: tuple[np.ndarray, np.ndarray, np.ndarray], total: int, vocabulary: int) -> np.ndarray:
    token, context, pair = (x.astype(float) for x in counts)
    return np.stack([pair / np.maximum(context, 1), token / max(total, 1), np.full(len(token), 1 / (vocabulary + 1))], 1)


def learn_weights(events: DataFrame, rounds: int) -> np.ndarray:
    """Mixture weights for each bucket, from rows (bucket bytes, estimates float32); a few sums a round reach the driver."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    weights[0] = [0.0, 0.9, 0.1]  # the context was never seen

    def responsibilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CONTEXTS, 3))
        for batch in batches:
            for buckets, values in zip(batch.column("buckets").to_pylist(), batch.column("estimates").to_pylist(), strict=True):
                bucket = np.frombuffer(buckets, np.uint8)
                mixed = np.frombuffer(values, np.float32).reshape(-1, 3) * weights[bucket]
                mixed /= mixed.sum(1, keepdims=True)
                for k in range(3):
                    sums[:, k] += np.bincount(bucket, mixed[:, k], CONTEXTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CONTEXTS)), *(pa.array(sums[:, k].copy()) for k in range(3))], names=["bucket", "s0", "s1", "s2"])

    for _ in range(rounds):
        parts = events.mapInArrow(responsibilities, "bucket long, s0 double, s1 double, s2 double")
        for r in parts.groupBy("bucket").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(3))).collect():
            sums = np.array([r["s0"], r["s1"], r["s2"]])
            if sums.sum() > 0:
                weights[r["bucket"]] = sums / sums.sum()
    return weights


def score_texts(docs: DataFrame, *, folds: int = 7, held: int = 2, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    The model learns from rows whose crc32(doc_id) mod ``folds`` isn't ``held``; a null doc_id is one of
    these.  Texts are lower-cased in A-Z; their tokens are their words and one end, which all that a null
    or empty text has.  Scores are log10 probabilities.  Repeated rows count and come back as often.  A very long
    text is scored whole and makes its block as much larger.  Other columns are not looked at.
    """
    crc = lambda salt: F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt)).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // settings.block_bytes))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    kind = F.when(out, TEST).when(crc("deleted") % settings.deleted == 0, DELETED).otherwise(KEPT)
    # by row, so that rows that repeat doc_id and text don't meet in one block
    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n))
    blocks = bucketed(rows.withColumn("block", place * 3 + kind), "texts", "block", min(3 * n, MOST_TASKS))

    bits = int(n).bit_length()
    tasks = max(1, min(total // settings.task_bytes, MOST_TASKS))
    if n <= settings.direct_blocks:
        answers = summed = _answers(_counted(blocks, bits), tasks)
    else:
        answers, summed = _in_two_steps(blocks, bits, tasks)
    totals = summed.where(f"block = -1 and part < {1 << bits}").agg(*(F.sum(c) for c in _TOTALS)).first()
    n_all, v_all, n_kept, v_kept = (x or 0 for x in totals)

    def events(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        counts = _looked_up(_Block.of(texts.column("text")), found, "kept")
        estimates = _estimates(counts, n_kept, v_kept).astype(np.float32)
        return pa.table({"buckets": pa.array([_bucket(counts[1]).astype(np.uint8).tobytes()], pa.binary()), "estimates": pa.array([estimates.tobytes()], pa.binary())})

    def by_block(kinds: str):
        return blocks.where(kinds).groupBy("block").cogroup(answers.where("block >= 0").where(kinds).groupBy("block"))

    weights = learn_weights(stored(by_block(f"block % 3 = {DELETED}").applyInArrow(events, "buckets binary, estimates binary"), "events"), settings.rounds)

    def scores(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        block = _Block.of(texts.column("text"))
        counts = _looked_up(block, found, "trained")
        mixed = np.log10((_estimates(counts, n_all, v_all) * weights[_bucket(counts[1])]).sum(1))
        base = np.log10((counts[0].astype(float) + 1) / (n_all + v_all + 1))
        begin = block.first[:-1]
        tokens = len(begin)
        return pa.table({
            "doc_id": texts.column("doc_id"),
            "held_out": pa.array(np.full(tokens, key[0].as_py() % 3 == TEST)),
            "n_tokens": pa.array(np.diff(block.first)),
            "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), begin)),
            "train_tokens": pa.array(np.full(tokens, n_all, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, begin)),
            "score": pa.array(np.add.reduceat(mixed, begin)),
        })

    return by_block("block >= 0").applyInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
