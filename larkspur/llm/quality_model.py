"""A quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

A document becomes a few statistics of its text, standardised by the training rows.  Random Fourier
features ``sqrt(2/D) cos(Wx + b)`` with normal W make a linear model approximate one with a Gaussian
kernel.  Each task sums ``Z'Z`` and ``Z'y`` over its rows for each of FOLDS folds; Spark adds these up row by row of
the matrices, and the driver solves systems of D + 1 unknowns: one of all rows, whose scores count, and one
without each fold.  Isotonic regression calibrates on scores that a row gets from the system without its own
fold, as scores of rows that the ridge has seen are too sure of themselves; it works over BINS equal cells,
which bounds what the driver sees.  All labelled training rows are used, without a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored
from ._text import pieces, texts_of, words_of

STATISTICS = ("words", "bytes", "word_bytes", "capitals", "digits", "symbols", "bars", "exclaims", "marks", "high", "lines", "distinct", "repeats", "pairs", "line_repeats", "short")
BINS = 2048
FOLDS = 5  # of the training rows, for calibration


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 4.0  # of the kernel, in standard deviations
    ridge: float = 1e-3  # for each training row
    seed: int = 6


def _shares(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; an empty one has zeros."""
    words = words_of(data, offsets)
    n, size = words.count.astype(float), np.diff(offsets).astype(float)
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
    of = np.isin
    byte = {
        "capitals": (data >= 65) & (data <= 90),
        "digits": (data >= 48) & (data <= 57),
        "symbols": of(data, np.frombuffer(b"#*$%&<>", np.uint8)),
        "bars": data == ord("|"),
        "exclaims": data == ord("!"),
        "marks": of(data, np.frombuffer(b".,;:?'\"()-", np.uint8)),
        "high": data >= 128,
    }
    h, text = words.hashes(), words.text_of_word()
    place = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[place][1:] != h[place][:-1]) | (text[place][1:] != text[place][:-1])
    distinct = np.bincount(text[place][new], minlength=len(n)) if len(h) else np.zeros(len(n))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    second = np.zeros(len(h), bool)
    second[2:] = (h[2:] == h[:-2]) & (text[2:] == text[:-2])
    lines = _shares(data == 10, offsets) + 1.0
    # a line's hash from its words: a sum, with the words' order left out
    line = np.cumsum(data == 10)[words.start] if len(h) else np.zeros(0, np.int64)
    edges = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
    sums = np.add.reduceat(h, edges) if len(h) else h
    owner = text[edges]
    order = np.lexsort((sums, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (sums[order][1:] == sums[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    line_repeats = np.bincount(owner[order][same], minlength=len(n)) if len(h) else np.zeros(len(n))
    word_size = words.end - words.start
    columns = [np.log1p(n), np.log1p(size), np.bincount(text, word_size, len(n)) / per_word]
    columns += [_shares(m, offsets) / per_byte for m in byte.values()]
    columns += [lines / per_word, distinct / per_word, np.bincount(text, again, len(n)) / per_word, np.bincount(text, second, len(n)) / per_word, line_repeats / lines, np.bincount(text, word_size <= 3, len(n)) / per_word]
    return np.where(size[:, None] > 0, np.stack(columns, 1), 0.0)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1)))


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's text; a null text counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, j, data, offsets in pieces(*texts_of(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, j - k), _lists(statistics(data, offsets))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    levels: np.ndarray | None = None  # calibrated score of each bin

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase), np.ones((len(x), 1))], 1)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The cell of a raw score; raw scores from -0.5 to 1.5 have BINS cells."""
        return cells(self.features(x) @ self.ridge)


def cells(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def solve(system: np.ndarray, rows: float, settings: Settings) -> np.ndarray:
    """Ridge weights from ``Z'Z`` with ``Z'y`` as its last column."""
    strength = settings.ridge * rows / settings.features
    return np.linalg.solve(system[:, :-1] + strength * np.eye(len(system)), system[:, -1])


def isotonic(bins: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The level of every bin: pooled means of neighbouring bins that violate the order, straight lines between."""
    blocks: list[list[float]] = []
    for b, s, c in zip(bins, sums, counts, strict=True):
        blocks.append([s, c, b, b])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, _, to = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2], to]
    at = [x for b in blocks for x in (b[2], b[3])]
    level = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.interp(np.arange(BINS), at, level)


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from ``rows`` (x array<double>, y 0 or 1, fold int).  Without rows all scores are 0.5.

    ``fold`` is 0 to FOLDS - 1; if only one of these has rows, calibration takes the scores of the ridge itself.
    """
    width, size = len(STATISTICS), settings.features + 1
    moments = [f(F.get("x", F.lit(i))).alias(f"{c}{i}") for c, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(width)]
    sums = rows.select(F.count("*").alias("n"), *moments).first()
    rng = np.random.default_rng(settings.seed)
    mean, scale = (np.array([sums[f"{c}{i}"] or 0.0 for i in range(width)]) for c in "ms")
    weights, phase = rng.normal(size=(width, settings.features)) / settings.width, rng.uniform(0, 2 * np.pi, settings.features)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), weights, phase, np.zeros(size))
    if not sums["n"]:
        model.levels = np.full(BINS, 0.5)
        return model
    rows = rows.select("x", F.col("y").cast("double").alias("y"), F.col("fold").cast("long").alias("fold"))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((FOLDS, size, size + 1)), np.zeros(FOLDS)
        for batch in batches:
            z, y, fold = model.features(_matrix(batch.column("x"), width)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in np.unique(fold):
                own = fold == k
                total[k] += z[own].T @ np.concatenate([z[own], y[own, None]], 1)
                n[k] += own.sum()
        some = np.flatnonzero(n)
        place = (some[:, None] * size + np.arange(size)).reshape(-1)
        counted = np.concatenate([total[some].reshape(-1, size + 1), np.repeat(n[some], size)[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(place), _lists(counted)], names=["i", "v"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = _matrix(table.column("v").combine_chunks(), size + 2).sum(0)
        return pa.table({"i": pa.array([key[0].as_py()]), "v": _lists(total[None, :])})

    folds = np.zeros((FOLDS, size, size + 2))
    parts = rows.mapInArrow(equations, "i long, v array<double>").groupBy("i").applyInArrow(add, "i long, v array<double>")
    for r in parts.toLocalIterator():
        folds[r["i"] // size, r["i"] % size] = r["v"]
    system, counts = folds[:, :, :-1], folds[:, 0, -1]
    model.ridge = solve(system.sum(0), counts.sum(), settings)
    without = [solve(system.sum(0) - system[k], counts.sum() - counts[k], settings) if 0 < counts[k] < counts.sum() else model.ridge for k in range(FOLDS)]
    ridges = np.stack(without, 1)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.features(_matrix(batch.column("x"), width)) @ ridges
            own = raw[np.arange(len(raw)), batch.column("fold").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(cells(own)), batch.column("y")], names=["bin", "y"])

    found = rows.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y"), F.count("*"))
    model.levels = isotonic(*(np.array(c, float) for c in zip(*sorted(found.collect()), strict=True)))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of rows of text_statistics; scores run from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.levels[model.bins(_matrix(batch.column("x"), len(STATISTICS)))])], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``.

    Labels (doc_id, quality) teach only where crc32(doc_id) mod ``folds`` isn't ``held``; null labels
    and ids teach nothing, and repeated rows teach as often as they come.  Null and empty texts get the
    score of an empty text.  A null doc_id isn't held out.  A very long text counts whole, as one row.  Other
    columns are not looked at.
    """
    stats = stored(text_statistics(docs), "statistics")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    known = labels.select("doc_id", F.col("quality").alias("y")).where("y is not null").where(~out)
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(FOLDS)).alias("fold")
    model = fit(stored(stats.join(known, "doc_id").select("x", "y", fold), "training"), settings)
    return score(stats, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
