"""Product codes of vectors: codebooks found by Lloyd's rounds, with Yinyang bounds that spare most distances.

A vector is cut into parts; each part has a codebook of its own.  Per part, the codebook's entries are clustered into
a few groups once.  A row keeps, per part and group, a lower bound of the distance to the group's entries other than
its own.  When entries move, the bound shrinks by the longest move in the group; only groups whose bound
doesn't exceed the exact distance to the row's own entry are looked at.  Distances are whole numbers and compared as such,
so ties go to the lower index whatever the bounds say; bounds are rounded so that they never spare too much.

Codes and bounds travel with the rows as a table between rounds.  Sums per entry are added up a partition at a time and
then by Spark; what reaches the driver is the codebooks, whose size doesn't depend on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored
from ._vectors import finite, integers, largest, matrix

ROWS = 4096  # looked at together
FAR = np.iinfo(np.int64).max


@dataclass
class Codebooks:
    """``entries``: parts x entries x positions, whole numbers.  ``groups``: parts x entries, the group of each entry."""

    entries: np.ndarray
    groups: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups.max(initial=-1)) + 1

    def moves(self, before: Codebooks) -> np.ndarray:
        """Parts x groups: at least the longest way that an entry of the group has moved."""
        far = np.nextafter(np.sqrt(_squares(self.entries - before.entries).astype(np.float64)), np.inf)
        out = np.zeros((len(far), self.n_groups))
        for p, g in enumerate(self.groups):
            np.maximum.at(out[p], g, far[p])
        return out


def _squares(difference: np.ndarray) -> np.ndarray:
    """Squared lengths along the last axis, exact up to FAR - 1, which stands for all from there on."""
    if largest(difference) < 2**28:
        return (difference * difference).sum(axis=-1)
    wide = difference.astype(object)
    return np.minimum((wide * wide).sum(axis=-1), FAR - 1).astype(np.int64)


def _below(squares: np.ndarray) -> np.ndarray:
    """Roots of squared distances as 32-bit numbers, never above the true root; FAR gives infinity."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.float32)
    return np.where(squares == FAR, np.float32(np.inf), np.nextafter(root, np.float32(-np.inf)))


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry of each part: a few rounds of k-means, started at entries far from each other."""
    out = np.zeros(entries.shape[:2], np.int64)
    for p, e in enumerate(entries.astype(np.float64)):
        if not len(e):
            continue
        centres = e[:1]
        while len(centres) < min(groups, len(e)):
            away = ((e[:, None] - centres[None]) ** 2).sum(-1).min(1)
            centres = np.vstack([centres, e[away.argmax()]])
        for _ in range(rounds):
            out[p] = ((e[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            centres = np.stack([e[out[p] == k].mean(0) if (out[p] == k).any() else c for k, c in enumerate(centres)])
    return out


def assign(x: np.ndarray, books: Codebooks, codes: np.ndarray | None = None, lower: np.ndarray | None = None, moves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, lower bounds (rows x parts x groups), squared distances (rows x parts), and the number of distances computed.

    x: rows x parts x positions.  Without earlier codes and bounds every entry is looked at.
    """
    n, parts, _ = x.shape
    n_entries, n_groups = books.entries.shape[1], books.n_groups
    new, bound, nearest = np.zeros((n, parts), np.uint8), np.zeros((n, parts, n_groups), np.float32), np.zeros((n, parts), np.int64)
    rows, computed = np.arange(n), 0
    for p in range(parts):
        far = np.full((n, n_entries), FAR, dtype=np.int64)
        entries, group = books.entries[p], books.groups[p]
        if codes is None:
            look = np.ones((n, n_groups), bool)
            left = np.full((n, n_groups), np.inf, np.float32)
        else:
            own = _squares(x[:, p] - entries[codes[:, p]])
            far[rows, codes[:, p]] = own
            # less than the difference by more than doubles can err in it
            left = np.nextafter((lower[:, p].astype(np.float64) * (1 - 1e-9) - moves[p] * (1 + 1e-9)).astype(np.float32), np.float32(-np.inf))
            look = left.astype(np.float64) <= np.nextafter(np.sqrt(own.astype(np.float64)), np.inf)[:, None]
            left[look] = np.inf
            computed += n
        for g in range(n_groups):
            some, members = np.flatnonzero(look[:, g]), np.flatnonzero(group == g)
            if len(some):
                far[np.ix_(some, members)] = _squares(x[some, p][:, None] - entries[members][None])
                computed += len(some) * len(members)
        new[:, p] = far.argmin(1)  # the first of equal ones
        nearest[:, p] = far[rows, new[:, p]]
        far[rows, new[:, p]] = FAR
        for g in range(n_groups):
            bound[:, p, g] = np.minimum(left[:, g], _below(far[:, group == g].min(1, initial=FAR)))
    if n_entries and nearest.max(initial=0) >= FAR - 1:
        raise OverflowError("a squared distance is beyond 64 bits")
    return new, bound, nearest, computed


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return matrix(column, width).reshape(len(column), parts, width // parts)


def _bytes(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _assigned(rows: DataFrame, width: int, books: Codebooks, moves: np.ndarray | None) -> DataFrame:
    """``rows`` with their codes, bounds and squared distance under ``books``; ``moves`` since the codes that they have."""
    parts, n_groups = len(books.entries), books.n_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                b = batch.slice(k, ROWS)
                before = () if moves is None else (_bytes(b["codes"], np.uint8, (parts,)), _bytes(b["lower"], np.float32, (parts, n_groups)), moves)
                codes, lower, nearest, _ = assign(_parts(b["v"], parts, width), books, *before)
                pack = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                yield pa.record_batch([b["row"], b["v"], pack(codes), pack(lower), pa.array(nearest.sum(1))], ["row", "v", "codes", "lower", "error"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, v array<long>, codes binary, lower binary, error long")


def _updated(rows: DataFrame, width: int, books: Codebooks) -> Codebooks:
    """Each entry replaced by the mean of its parts, rounded down; an entry without any stays."""
    parts, n_entries, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, n_entries), np.int64), np.zeros((parts, n_entries, size), np.int64)
        for b in batches:
            x, codes = _parts(b["v"], parts, width), _bytes(b["codes"], np.uint8, (parts,))
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], x[:, p])
        p, e = np.nonzero(count)
        yield pa.record_batch([pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(total[p, e, k]) for k in range(size))], names)

    names = ["part", "entry", "n", *(f"s{k}" for k in range(size))]
    sums = rows.select("v", "codes").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    entries = books.entries.copy()
    for r in sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
        entries[r["part"], r["entry"]] = [r[c] // r["n"] for c in names[3:]]
    return Codebooks(entries, books.groups)


def compress(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 6, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` with codes (binary, a byte a part) and error (long), and the codebooks: parts x entries x positions.

    Each component becomes floor(``scale`` * x); vectors are cut into ``parts`` equal consecutive parts.  A part's
    codebook starts as that part of the first ``entries`` (256 at most) rows by id; with fewer rows it is as small.  Each
    round assigns all parts to their nearest entry, the lower index on ties, and moves the entries to the means; at
    last the parts are assigned again.  error is the sum of the squared distances then.

    Rows whose vector is null or has null or non-finite components are left out; all others come back, repeated ones
    too, with their columns (but any named codes or error).  Rows without an id come last in the start's order, rows of one id in
    order of their vectors.  Vectors of different length, or of one that ``parts`` doesn't divide, are filled up
    with zeros.  Without rows there is no codebook.  An error beyond 64 bits is an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: take 1 to 256 entries")
    rest = [c for c in vectors.columns if c not in ("codes", "error")]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")
    rows = stored(vectors.where(finite(vector)).select(row, F.col(id).alias("id"), integers(vector, scale).alias("v")), "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts)) * parts
    start = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    first = matrix(pa.array([r["v"] for r in start], pa.list_(pa.int64())), width).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    books, moves = Codebooks(first, grouped(first, groups)), None
    rows = rows.drop("id")
    if start:
        for k in range(rounds):
            rows = stored(_assigned(rows, width, books, moves), f"codes-{k}")
            before, books = books, _updated(rows, width, books)
            moves = books.moves(before)
    out = stored(_assigned(rows, width, books, moves).select("row", "codes", "error"), "codes")
    return out.select("row.*", "codes", "error"), books.entries
