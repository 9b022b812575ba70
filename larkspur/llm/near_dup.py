"""MinHash near-deduplication with fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017).

A sketch has ``bins`` coordinates.  In round i each shingle is hashed to one bin with a value
that sorts after all values of earlier rounds; rounds go on until no bin is empty, and from round
``bins`` on a bin that is still empty takes the least value of all shingles.  So every coordinate
fills, sketches agree in a coordinate with a probability equal to the Jaccard similarity, and the
share of agreeing coordinates is concentrated as for independent hash functions, at a cost of
``n + bins * log(bins)`` a document and not ``n * bins``.

Banding makes candidates: documents whose sketches agree in a whole band.  With 64 bands of 6
coordinates a pair of similarity 0.75 is missed in 4 of 10^6 cases, a closer one more rarely.  Of
these only pairs whose sketches agree in ``LEAST_AGREED`` of the coordinates or more are suspects: a
pair of similarity 0.75 falls below in about 2 of 10^6 cases (4.6 standard deviations).

No step returns the pairs within a group.  Equal word sequences form a class first, and one document
stands for it.  Suspects are gathered into groups: in a band's bucket each document is laid beside
the bucket's first one, and where documents of several groups are left in a bucket, those outside its
largest group are laid beside the others.  Then the full shingle sets of a group meet in blocks, and each
pair that nothing connects yet is tested exactly.  Blocks hold a bounded number of documents or shingles, and
return the edges of a spanning forest: fewer than the rows that they read, however alike these are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored
from ._text import U, give_back, join_hashes, mix, pieces, seeded, texts_of, window_hashes, words_of

WORDS, BANDS, ROWS, NUMERATOR = 5, 64, 6, 75
_EMPTY = U(2**64 - 1)
LEAST_AGREED = 0.65
SKETCHES, SHINGLES = 4096, 1 << 19  # a block has at most about twice as many, of one row at least
TOGETHER = 1024  # rows of small blocks that are looked at together
SALTS = 64  # a hub's rows are dealt over so many keys
_SKETCHES = "doc_id long, n_shingles long, class_a long, class_b long, bands array<long>, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, where each text's begin, and the word hashes' class.

    A text with fewer than n words has its whole word sequence as the one shingle; none if it has no word.
    """
    words = words_of(data, offsets, lower=True)
    h, texts, count = words.hashes(), len(offsets) - 1, words.count
    starts = words.starts_of(n)
    values = window_hashes(h, n)[starts] if len(starts) else np.zeros(0, U)
    size = np.maximum(count - n + 1, 0)
    for k in np.flatnonzero((count > 0) & (count < n)):
        whole = h[words.first[k] : words.first[k + 1]]
        at = int(size[:k].sum())
        values = np.insert(values, at, window_hashes(whole, len(whole))[0] ^ seeded(100 + len(whole)))
        size[k] = 1
    first = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(first[:-1], first[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[first[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[first]
    return values[keep], kept, _sequence_hashes(words, texts)


def _sequence_hashes(words, texts: int) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence: sums over words of hash times place."""
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.count)
    out = np.zeros((texts, 2), U)
    for k in (0, 1):
        terms = mix(words.hashes(7 + k) + mix(place.astype(U) + seeded(50 + k)))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(terms, dtype=U)])
        out[:, k] = mix(sums[words.first[1:]] - sums[words.first[:-1]] + words.count.astype(U))
    return out


def sketches(values: np.ndarray, first: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """The sketch of each set; a row of a set without elements stays empty."""
    sets = len(first) - 1
    owner = np.repeat(np.arange(sets), np.diff(first))
    flat = np.full(sets * bins, _EMPTY)
    unfilled = np.where(np.diff(first) > 0, bins, 0)
    x = values
    for i in range(2 * bins):
        if not len(x):
            break
        h = mix(x + seeded(1000 + i))
        value = (h & U(0xFFFFFFFF)) | U(i << 32)
        if i < bins:
            at = owner * bins + (((h >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
        else:
            at = owner * bins + (i - bins)
        new = flat[at] == _EMPTY
        at = at[new]
        np.minimum.at(flat, at, value[new])
        np.subtract.at(unfilled, np.unique(at) // bins, 1)
        open_ = unfilled[owner] > 0
        if not open_.all():
            x, owner = x[open_], owner[open_]
    return flat.reshape(sets, bins)


def band_hashes(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sketch.reshape(len(sketch), bands, -1)
    h = np.broadcast_to(mix(np.arange(bands).astype(U) + seeded(3)), rows.shape[:2])
    for k in range(rows.shape[2]):
        h = join_hashes(h, rows[:, :, k])
    return h


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _bytes(column: pa.Array) -> np.ndarray:
    """An Arrow column of sketches as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        for k, j, part, begin in pieces(data, offsets, 2 << 20, 1024):
            values, first, classes = shingle_sets(part, begin)
            sketch = sketches(values, first)
            bands = band_hashes(sketch).view(np.int64)
            low = np.ascontiguousarray((mix(sketch) & U(0xFF)).astype(np.uint8))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(k, j - k), pa.array(np.diff(first)), *(pa.array(np.ascontiguousarray(classes[:, c]).view(np.int64)) for c in (0, 1)), lists, _binary(low)],
                names=["doc_id", "n_shingles", "class_a", "class_b", "bands", "sketch"],
            )
    give_back()


def _screen_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            agreed = (_bytes(batch.column("sketch_a")) == _bytes(batch.column("sketch_b"))).mean(1)
            yield batch.select(["a", "b"]).filter(pa.array(agreed >= LEAST_AGREED))


def screen(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches agree enough to be suspects.

    Many pairs may have one ``a``: they are dealt over SALTS keys, and its sketch is sent to those in use.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    of_a = sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("sketch_a"))
    of_b = sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("sketch_b"))
    heads = pairs.select("a", "part").distinct().join(of_a, "a")
    both = pairs.join(of_b, "b").join(heads, ["a", "part"])
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_screen_batches, "a long, b long")


class _Sketched:
    """Sketches of the documents of some blocks; pairs match if they may be similar enough."""

    def __init__(self, table: pa.Table) -> None:
        self.sketch = _bytes(table.column("payload").combine_chunks())
        self.size = table.column("n").to_numpy()

    def open_block(self, lo: int, hi: int) -> None:
        pass

    def matches(self, o: int, at: np.ndarray) -> np.ndarray:
        return at[(self.sketch[at] == self.sketch[o]).mean(1) >= LEAST_AGREED]


class _Sets:
    """Shingle sets of the documents of some blocks; pairs match if they are similar enough."""

    def __init__(self, table: pa.Table) -> None:
        parts, size = [], []
        for _, _, data, offsets in pieces(*texts_of(table.column("payload")), 2 << 20):
            values, first, _ = shingle_sets(data, offsets)
            parts.append(values)
            size.append(np.diff(first))
        self.values, self.size = np.concatenate(parts), np.concatenate(size)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def open_block(self, lo: int, hi: int) -> None:
        """Number the block's distinct shingles."""
        distinct, self.ids = np.unique(self.values[self.first[lo] : self.first[hi]], return_inverse=True)
        self.mark, self.base = np.zeros(len(distinct), np.uint8), self.first[lo]

    def matches(self, o: int, at: np.ndarray) -> np.ndarray:
        own = self.ids[self.first[o] - self.base : self.first[o + 1] - self.base]
        self.mark[own] = 1
        size = self.size[at]
        ends = np.cumsum(size)
        where = np.repeat(self.first[at] - self.base - (ends - size), size) + np.arange(ends[-1])
        both = np.add.reduceat(self.mark[self.ids[where]], ends - size, dtype=np.int64)
        self.mark[own] = 0
        return at[100 * both >= NUMERATOR * (len(own) + size - both)]


def _forest(kind: type, within: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b) that join documents of different labels in a block, for matching pairs; none closes a circle.

    Rows come sorted by block, outliers first.  Each outlier meets the rows after it, or, without
    ``within``, the rows after the outliers.
    """

    def flush(table: pa.Table) -> pa.RecordBatch:
        block = np.stack([table.column(c).to_numpy() for c in _BLOCK])
        outlier, doc, label = (table.column(c).to_numpy() for c in ("outlier", "doc", "label"))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0).any(0), [True]]))
        found: list[tuple[int, int]] = []
        held, base, end = None, 0, 0
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi > end:
                base, end = lo, max(hi, int(edges[np.searchsorted(edges, lo + TOGETHER, side="right") - 1]))
                held = kind(table.slice(base, end - base))
            own = label[lo:hi].copy()
            if (own == own[0]).all():
                continue
            held.open_block(lo - base, hi - base)
            size, cut = held.size[lo - base : hi - base], int(outlier[lo:hi].sum())
            for o in range(cut):
                begin = o + 1 if within else cut
                least, most = np.minimum(size[begin:], size[o]), np.maximum(size[begin:], size[o])
                at = begin + np.flatnonzero((own[begin:] != own[o]) & (100 * least >= NUMERATOR * most) & (least > 0))
                if not len(at):
                    continue
                at = held.matches(lo - base + o, lo - base + at) - (lo - base)
                labels, first = np.unique(own[at], return_index=True)
                found += [(int(doc[lo + o]), int(doc[lo + x])) for x in at[first]]
                own[np.isin(own, labels)] = own[o]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # a block may go on in the next batch: its rows wait
            ids = [batch.column(c).to_numpy() for c in _BLOCK]
            last = np.flatnonzero(np.any([x != x[-1] for x in ids], 0))
            cut = int(last[-1]) + 1 if len(last) else 0
            goes_on = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in _BLOCK)
            if held and not (goes_on and not cut):
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield flush(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))
        give_back()

    return run


_BLOCK = ("grp", "slice", "chunk")


def _in_blocks(rows: DataFrame, kind: type, *, within: bool) -> DataFrame:
    """_forest over ``rows`` with the columns of _BLOCK, outlier, doc, label, n and payload."""
    columns = (*_BLOCK, "outlier", "doc", "label", "n", "payload")
    dealt = rows.select(*columns).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, F.desc("outlier"), "doc")
    return dealt.mapInArrow(_forest(kind, within), "a long, b long")


def across(named: DataFrame, payload: DataFrame, kind: type, most: int) -> DataFrame:
    """Edges between the labels of each group of ``named`` (grp, doc, label, w), tested on ``payload`` (doc, n, payload).

    A group's documents outside its largest label (outliers) are dealt into slices and all its documents into
    chunks, each of a weight ``w`` up to about ``most``; each slice meets each chunk in a block.
    """
    by_label = named.groupBy("grp", "label").agg(F.sum("w").alias("w"))
    sizes = by_label.groupBy("grp").agg(
        F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("all"), F.count("*").alias("labels")
    )
    mixed = stored(
        sizes.where("labels > 1").select(
            "grp",
            F.col("top.label").alias("top"),
            F.ceil((F.col("all") - F.col("top.w")) / most).cast("int").alias("slices"),
            F.ceil(F.col("all") / most).cast("int").alias("chunks"),
        ),
        "mixed",
    )
    if mixed.isEmpty():
        return named.sparkSession.createDataFrame([], "a long, b long")
    rows = named.join(mixed, "grp").join(payload, "doc")
    here = lambda n, seed: F.array(F.pmod(F.xxhash64("doc", F.lit(seed)), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    member = F.struct(F.lit(0).alias("outlier"), every("slices").alias("s"), here(F.col("chunks"), 1).alias("c"))
    outlier = F.struct(F.lit(1).alias("outlier"), here(F.col("slices"), 2).alias("s"), every("chunks").alias("c"))
    roles = F.filter(F.array(member, outlier), lambda r: (r["outlier"] == 0) | (F.col("label") != F.col("top")))
    rows = rows.withColumn("r", F.explode(roles)).withColumn("slice", F.explode("r.s"))
    rows = rows.withColumn("chunk", F.explode("r.c")).withColumn("outlier", F.col("r.outlier"))
    return _in_blocks(rows, kind, within=False)


def suspects(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc_id, component) of documents that may be linked: any two that may be share a component.

    ``members`` has bucket, doc and leader, the least document of the bucket; ``sketches`` doc, n and sketch.
    """
    others = members.where("doc <> leader")
    pairs = others.select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    stars = stored(screen(pairs, sketches), "stars")
    found = components(stars)
    named = others.select(F.col("bucket").alias("grp"), "doc").join(found.withColumnRenamed("doc_id", "doc"), "doc", "left")
    named = named.select("grp", "doc", F.coalesce("component", "doc").alias("label"), F.lit(1).alias("w"))
    payload = sketches.select("doc", "n", F.col("sketch").alias("payload"))
    more = stored(across(named, payload, _Sketched, SKETCHES).distinct(), "suspects")
    return found if more.isEmpty() else components(stars.unionByName(more))


def confirmed(groups: DataFrame, sizes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, component) by links between documents of one of the ``groups`` (doc_id, component).

    ``sizes`` has doc and n, ``docs`` doc_id and text.  A group of over SHINGLES shingles is dealt into parts,
    each with the group's first document; what then is left unconnected meets across parts.
    """
    named = groups.select(F.col("component").alias("grp"), F.col("doc_id").alias("doc"))
    named = stored(named.join(sizes.groupBy("doc").agg(F.max("n").alias("w")), "doc").select("grp", "doc", "w"), "groups")
    texts = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("payload"))
    payload = named.select("doc", F.col("w").alias("n")).join(texts, "doc").distinct()
    parts = named.groupBy("grp").agg(F.ceil(F.sum("w") / SHINGLES).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    own = F.array(F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = named.join(parts, "grp").join(payload, "doc")
    rows = rows.withColumn("chunk", F.explode(F.when(F.col("doc") == F.col("grp"), everywhere).otherwise(own)))
    rows = rows.withColumns({"slice": F.lit(0), "outlier": F.lit(1), "label": F.col("doc")})
    links = stored(_in_blocks(rows, _Sets, within=True), "links")
    large = parts.where("parts > 1")
    if not large.isEmpty():
        found = components(links).withColumnRenamed("doc_id", "doc")
        left = named.join(large.select("grp"), "grp", "left_semi").join(found, "doc", "left")
        left = left.select("grp", "doc", F.coalesce("component", "doc").alias("label"), "w")
        links = links.unionByName(stored(across(left, payload, _Sets, SHINGLES), "links"))
    return components(links)


def _with_least(rows: DataFrame) -> DataFrame:
    """``rows`` (u, v) with ``m``, the least v of u; the rows of a hub are dealt over SALTS keys."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    some = rows.groupBy("u", "part").agg(F.min("v").alias("m"))
    whole = some.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    return rows.join(whole.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of ``edges`` (u, v) has one v, which is no u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out + into > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of all ends of ``links`` (a, b), by alternating large and small stars.

    Each step is a shuffle of the links with partial minima; the number of steps grows with the
    logarithm of a component's diameter.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(ends.where("u <> v").distinct(), "links")
    while not _are_stars(edges):
        both = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
    roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Links join documents whose sets of distinct five-word shingles of the lower-cased text have a
    Jaccard similarity of 0.75 or more; ``component_id`` is the smallest doc_id that links reach.
    A null or empty text, or one of white space only, has no shingle and links with nothing.  Rows
    that repeat a doc_id come back as often; if their texts differ, what links with one of them is linked
    with the doc_id.  A null doc_id takes no part: its component is null and it is kept.  A very long text
    is compared whole, and a block that it fills has few other texts.  Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(_sketch_batches, _SKETCHES), "sketches")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    first = F.min_by(F.struct("bands", "sketch", "n_shingles"), "doc_id").alias("first")
    classes = some.groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"), first)
    classes = classes.select("class_a", "class_b", "rep", "first.bands", "first.sketch", F.col("first.n_shingles").alias("n"))
    classes = stored(classes, "classes")
    sketches = classes.select(F.col("rep").alias("doc"), "n", "sketch")
    members = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc"))
    shared = members.groupBy("bucket").agg(F.min("doc").alias("leader"), F.max("doc").alias("last"))
    shared = stored(shared.where("leader <> last").drop("last"), "shared")
    members = stored(members.join(shared, "bucket"), "buckets")

    found = confirmed(suspects(members, sketches), sketches, docs)
    # rows -> class -> component; both right sides hold one row a key
    named = classes.select("class_a", "class_b", "rep").join(found.withColumnRenamed("doc_id", "rep"), "rep", "left")
    named = named.select("class_a", "class_b", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "class_a", "class_b").join(named, ["class_a", "class_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    kept = component.isNull() | (component == F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
