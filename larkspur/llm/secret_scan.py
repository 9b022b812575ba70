"""Secrets in texts: three fixed patterns, and strings that look drawn by chance rather than named by people.

Two Markov models of characters judge each run of letters, digits and ``+/_=-``: one of random strings, one of ordinary
identifiers.  A run of ``least`` characters or more, letters a tenth of them at least, is a secret where the log-likelihood
ratio of the models is above the log odds that ``prior``, the share of such runs taken to be secrets, leaves against it.
A character that repeats the one before speaks for no secret, so rulers and fillers are none.

The models are trained on labelled samples.  Random: distinct strings that the patterns find in the corpus, and strings
drawn from the alphabets that keys are written in; either kind has half the weight, if there is any of the first.
Ordinary: all runs of the corpus whose kinds of characters (small, capital, digit, other) seldom change, counted
in every document.  Identifiers are words joined, so these words count, at a tenth, in capitals too, behind
``_``, ``/`` and ``-``, and joined by a capital.  What reaches the driver are two tables of transition counts.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored
from ._text import pieces, texts_of

SMALL, CAPITAL, DIGIT, OTHER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-"
ALPHABET = SMALL + CAPITAL + DIGIT + OTHER
# The alphabets that keys are usually written in.
KEY_ALPHABETS = (DIGIT + "abcdef", DIGIT + "ABCDEF", CAPITAL + "234567", CAPITAL + DIGIT, SMALL + DIGIT, SMALL + CAPITAL + DIGIT, SMALL + CAPITAL + DIGIT + "-_", SMALL + CAPITAL + DIGIT + "+/")
BREAK, STATES = 0, 1 + len(ALPHABET)  # the state between runs, and the number of states
_STATE = np.zeros(256, np.uint8)
_STATE[[ord(c) for c in ALPHABET]] = np.arange(1, STATES)
_KIND = np.array([9, *[0] * 26, *[1] * 26, *[2] * 10, *[3] * 5], np.uint8)

# The patterns of the contract, each with the group whose length counts and the length that it needs.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": (re.compile(_ASSIGN, re.I | re.A), 2, 8), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}
_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
CHUNK = 1 << 20  # bytes of text looked at together


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and the secret's own characters of the patterns' matches, in order of start, then of kind."""
    found = [(m.start(), m.end(), kind, m[group]) for kind, (pattern, group, least) in PATTERNS.items() for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class _Runs:
    """Maximal runs of ALPHABET in some texts: the state of each of their bytes and of the one before, and the runs' bounds."""

    at: np.ndarray  # place of each byte of a run
    state: np.ndarray
    before: np.ndarray
    first: np.ndarray  # where in ``at`` each run begins
    size: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> _Runs:
        state = _STATE[data]
        before = np.zeros_like(state)
        before[1:] = state[:-1]
        before[offsets[:-1][offsets[:-1] < offsets[1:]]] = BREAK
        at = np.flatnonzero(state)
        state, before = state[at], before[at]
        first = np.flatnonzero(before == BREAK)
        return cls(at, state, before, first, np.diff(np.append(first, len(at))))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0, values.dtype)

    def letters(self) -> np.ndarray:
        return self.sums((_KIND[self.state] < 2).astype(np.int64))

    def ordinary(self) -> np.ndarray:
        """True for runs with a letter whose kinds of characters change in at most a quarter of the places; a capital before small ones is no change."""
        now, past = _KIND[self.state], _KIND[self.before]
        changes = (now != past) & (self.before != BREAK) & ~((past == 1) & (now == 0))
        return (4 * self.sums(changes.astype(np.int64)) <= self.size) & (self.letters() > 0)

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each state follows each in the runs that ``of`` marks, their ends included."""
        inside = np.repeat(of, self.size)
        moves = np.bincount(self.before[inside].astype(np.int64) * STATES + self.state[inside], minlength=STATES * STATES).reshape(STATES, STATES)
        last = self.state[(self.first + self.size - 1)[of]]
        moves[:, BREAK] += np.bincount(last, minlength=STATES)
        return moves


def _counts_of(strings: Iterable[str]) -> np.ndarray:
    data, offsets = texts_of(pa.array(list(strings), pa.string()))
    runs = _Runs.of(data, offsets)
    return runs.counts(np.ones(len(runs.first), bool))


def _shares(counts: np.ndarray, surprise: float) -> np.ndarray:
    """Probabilities of the next character, the end left out; ``surprise`` of them is shared by all characters alike."""
    moves = counts[:, 1:].astype(np.float64)
    total = moves.sum(1, keepdims=True)
    known = np.divide(moves, total, out=np.full_like(moves, 1 / (STATES - 1)), where=total > 0)
    return (1 - surprise) * known + surprise / (STATES - 1)


def identifiers(words: np.ndarray) -> np.ndarray:
    """Transition counts of words, with those of the identifiers that are made of them."""
    small, capital = slice(1, 27), slice(27, 53)
    out = words.astype(np.float64)
    out[capital, capital] += words[small, small] / 10
    out[BREAK, capital] += words[BREAK, small] / 10
    ends, begins = words[:, BREAK].astype(np.float64), words[BREAK] / max(1, words[BREAK].sum())
    for c in "_/-":
        k = _STATE[ord(c)]
        out[:, k] += ends / 10
        out[k] += words[BREAK] / 10
    out[small, capital] += np.outer(ends[small], begins[small]) / 10
    out[BREAK, BREAK] = 0
    return out


@dataclass(frozen=True)
class Models:
    """``ratio``: log of how much likelier a character is after another in a random string than in an identifier."""

    ratio: np.ndarray

    @classmethod
    def of(cls, random_counts: list[np.ndarray], ordinary: np.ndarray, surprise: float = 0.05) -> Models:
        """From transition counts of random strings, kinds of equal weight, and of words."""
        kinds = [_shares(c, surprise) for c in random_counts if c.sum()]
        chance = sum(kinds) / len(kinds) if kinds else np.full((STATES, STATES - 1), 1 / (STATES - 1))
        ratio = np.zeros((STATES, STATES), np.float32)
        ratio[:, 1:] = np.log(chance) - np.log(_shares(identifiers(ordinary), surprise))
        np.fill_diagonal(ratio, np.minimum(ratio.diagonal(), 0))
        return cls(ratio)

    def of_string(self, text: str) -> float:
        states = [BREAK, *(int(_STATE[ord(c)]) for c in text)]
        return float(sum(self.ratio[a, b] for a, b in zip(states, states[1:], strict=False)))


def drawn_strings(each: int = 400, seed: int = 7) -> list[str]:
    """Random strings of 16 to 64 characters of each of KEY_ALPHABETS: samples whose label is certain."""
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randint(16, 64))) for letters in KEY_ALPHABETS for _ in range(each)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK bytes: the batch, first row, end, and their bytes."""
    for batch in batches:
        for k, end, data, offsets in pieces(*texts_of(batch.column("text")), most=CHUNK):
            yield batch, k, end, data, offsets


def _hinted(texts: pa.Array) -> list[tuple[int, str]]:
    """Place and text of those that a pattern may match in."""
    places = np.flatnonzero(pc.match_substring_regex(texts, _HINT).fill_null(False).to_numpy(zero_copy_only=False))
    return list(zip(places.tolist(), texts.take(pa.array(places)).to_pylist(), strict=True))


def train(docs: DataFrame, surprise: float = 0.05) -> Models:
    """Models from labelled samples of all texts of ``docs``; see the module's text.  Without texts the drawn strings alone count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, strings = np.zeros((STATES, STATES), np.int64), set()
        for batch, k, end, data, offsets in _texts(batches):
            runs = _Runs.of(data, offsets)
            words += runs.counts(runs.ordinary())
            strings.update(s[3] for _, t in _hinted(batch.column("text").slice(k, end - k)) for s in base_spans(t))
            if len(strings) > 10_000:
                yield pa.record_batch([pa.array(sorted(strings)), *[pa.nulls(len(strings), pa.int64())] * 2], names)
                strings = set()
        places = np.flatnonzero(words.ravel())
        yield pa.record_batch([pa.nulls(len(places), pa.string()), pa.array(places), pa.array(words.ravel()[places])], names)
        yield pa.record_batch([pa.array(sorted(strings), pa.string()), *[pa.nulls(len(strings), pa.int64())] * 2], names)

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            total += _counts_of(batch.column("sample").to_pylist()).ravel()
        places = np.flatnonzero(total)
        yield pa.record_batch([pa.array(places), pa.array(total[places])], ["place", "n"])

    def table(counted: DataFrame) -> np.ndarray:
        out = np.zeros(STATES * STATES, np.int64)
        for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():  # STATES squared rows at most
            out[r["place"]] = r["n"]
        return out.reshape(STATES, STATES)

    names = ["sample", "place", "n"]
    found = stored(docs.select("text").mapInArrow(count, "sample string, place long, n long"), "samples")
    samples = found.where("sample is not null").select("sample").distinct()
    kinds = [_counts_of(drawn_strings()), table(samples.mapInArrow(moves, "place long, n long"))]
    return Models.of(kinds, table(found.where("place is not null").select("place", "n")), surprise)


def scan(docs: DataFrame, models: Models, *, least: int = 16, prior: float = 1e-5) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end, ratio), in order of start, then of KINDS.

    Places are code points, ends exclusive.  The patterns' matches are there always, without a ratio; a random string is
    added where it overlaps none of them.  A run is judged whole: a key in the middle of a long path may be missed, and
    numbers with a letter or two, as account numbers, aren't found.  A null or empty text has none.  Rows stay as they are, repeated ones and
    null ids too; a column of ``docs`` named secrets is replaced.  Texts are searched whole, however long.
    """
    limit = math.log((1 - prior) / prior)
    rest = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, end, data, offsets in _texts(batches):
            found: list[list[tuple]] = [[] for _ in range(end - k)]
            for i, text in _hinted(batch.column("text").slice(k, end - k)):
                found[i] = [(kind, a, b, None) for a, b, kind, _ in base_spans(text)]
            runs = _Runs.of(data, offsets)
            ratio = runs.sums(models.ratio[runs.before, runs.state].astype(np.float64))
            chosen = np.flatnonzero((runs.size >= least) & (ratio >= limit) & (10 * runs.letters() >= runs.size))
            if len(chosen):
                begin = runs.at[runs.first[chosen]]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                text_of = np.searchsorted(offsets, begin, side="right") - 1
                start = points[begin] - points[offsets[text_of]]
                for i, a, n, r in zip(text_of.tolist(), start.tolist(), runs.size[chosen].tolist(), ratio[chosen].tolist(), strict=True):
                    if all(a + n <= b or c <= a for kind, b, c, _ in found[i] if kind != "random"):
                        found[i].append(("random", a, a + n, r))
                for spans in found:
                    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            secrets = pa.array([[dict(zip(("kind", "start", "end", "ratio"), s, strict=True)) for s in spans] for spans in found], pa.list_(span))
            yield pa.record_batch([batch.column("row").slice(k, end - k), secrets], ["row", "secrets"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, secrets array<struct<kind:string,start:long,end:long,ratio:double>>")
    return out.select("row.*", "secrets")
