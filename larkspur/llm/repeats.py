"""Substring deduplication: words of long passages that stand anywhere else go.

Which windows of ``window`` words repeat is found in two passes.  The first fills a count-min sketch:
tasks count what they have seen, Spark adds the sketches up slice by slice, and as counters only ever
share what they count, an estimate is never below the truth.  To keep the sketch small it counts anchors
instead of windows: the gram of ``gram`` words with the least hash in a window.  Equal windows have equal
anchors at the same offset, so a window repeats no more often than its anchor.  The second pass
groups exactly, by 128 bits of hash, the windows whose anchor is estimated to occur twice or more; none
that repeats is lost, and those that don't are few while the sketch isn't full.  The windows of one anchor
travel together, as do their answers.  Windows that a task finds twice itself are answered there and sent
once, so of a passage that a third of all documents hold a piece of input sends one copy.  An anchor that the
sketch has ``HOT`` times or more can have too many windows for one task: these travel singly, each to where equal
ones meet, and there only a bounded number is held.

Up to ``direct_bytes`` of text the sketch's "twice or more" and "hot" bits are broadcast, 4 rows of
``MOST_COUNTERS`` bits at most.  Beyond, its counters go on growing with the corpus, and stay where they are: texts
are dealt into blocks, written once as a table bucketed by block, and each block sends the slots of its anchors to the slices of the
sketch that these are in and gets their bits back in the same order.  Either way gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sql import text_of
from ._store import bucketed, stored
from ._text import U, Words, mix, pieces, seeded, texts_of, window_hashes, words_of

WINDOW, GRAM = 35, 24  # a mask has a bit for each place of a gram in a window: at most 31
LEAST_COUNTERS, MOST_COUNTERS, SLICE = 1 << 20, 1 << 29, 1 << 20
HOT, HELD = 1 << 16, 1 << 17  # HELD: equal windows that wait in a task, about
PIECE = 4 << 20  # bytes of text looked at together
_SEEDS = (seeded(31), seeded(32))


def sliding_argmin(h: np.ndarray, n: int) -> np.ndarray:
    """For each run of n values the index of the least, the first of equal ones."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(h)), 1
    while span < n:
        step = min(span, n - span)
        a, b = best[: len(best) - step], best[step:]
        best, span = np.where(h[b] < h[a], b, a), span + step
    return best[:count]


def _windows(words: Words, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the words where windows of one text begin, the anchor of each, and the grams' hashes."""
    starts = words.starts_of(n)
    h = words.hashes()
    if not len(starts):
        return starts, starts, h
    grams = window_hashes(h, gram)
    return starts, sliding_argmin(grams, n - gram + 1)[starts], grams


def _slots(anchors: np.ndarray, counters: int) -> Iterator[np.ndarray]:
    for seed in _SEEDS:
        yield (mix(anchors + seed) & U(counters - 1)).astype(np.int64)


def sketch(docs: DataFrame, counters: int, *, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Bits of counters by limit and row: those that have counted two or more anchors, and HOT or more."""
    hot = HOT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(*texts_of(batch.column("text")), PIECE):
                _, anchor, grams = _windows(words_of(data, offsets), window, gram)
                if not len(anchor):
                    continue
                for row, slots in enumerate(_slots(grams[np.unique(anchor)], counters)):
                    slot, times = np.unique(slots, return_counts=True)
                    cut = np.searchsorted(slot, np.arange(0, counters + SLICE, SLICE))
                    some = np.flatnonzero(cut[1:] > cut[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row * (counters // SLICE) + some),
                            pa.array([(slot[cut[s] : cut[s + 1]] - s * SLICE).astype(np.int32).tobytes() for s in some], pa.binary()),
                            pa.array([np.minimum(times[cut[s] : cut[s + 1]], 0xFFFF).astype(np.uint16).tobytes() for s in some], pa.binary()),
                        ],
                        names=["slice", "slots", "times"],
                    )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLICE, np.int32)
        for batch in batches:
            for slots, times in zip(batch.column("slots").to_pylist(), batch.column("times").to_pylist(), strict=True):
                at = np.frombuffer(slots, np.int32)
                total[at] = np.minimum(total[at] + np.frombuffer(times, np.uint16), hot)
        bits = [pa.array([np.packbits(total >= limit).tobytes()], pa.binary()) for limit in (2, hot)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), *bits], names=["slice", "twice", "hot"])

    parts = docs.select("text").mapInArrow(count, "slice long, slots binary, times binary")
    bits = np.zeros((2, 2, counters // 8), np.uint8)
    for r in parts.groupBy("slice").applyInArrow(add, "slice long, twice binary, hot binary").toLocalIterator():
        row, k = divmod(r["slice"], counters // SLICE)
        for limit, name in enumerate(("twice", "hot")):
            bits[limit, row, k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(r[name], np.uint8)
    return bits


def _test(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """64-bit values as a binary column of so many values a row."""
    ends = np.concatenate([[0], np.cumsum(8 * sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _found_twice(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (a, b), whether it is there twice or more, and whether it is the first of its like."""
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    twice, first = np.zeros(len(a), bool), np.ones(len(a), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    first[order[1:][same]] = False
    return twice, first


_RUNS = "gram long, doc_id long, text_hash long, pos int, mask int, windows binary"


def _runs(words: Words, begins: tuple[np.ndarray, np.ndarray, np.ndarray], likely: np.ndarray, hot: np.ndarray, ids: pa.Array, keys: pa.Array, window: int) -> pa.RecordBatch:
    """Runs of windows with one anchor that is estimated to occur twice or more, in some texts with these ids.

    ``pos`` is the run's first window, ``mask`` has a bit for each that is found twice here already,
    ``windows`` their hashes; it is empty, and ``gram`` any value, where no other task needs to see them.
    A window of a hot anchor is a run of its own, with another hash of its words as ``gram``.
    """
    starts, anchor, grams = begins
    at, anchor, hot = starts[likely], anchor[likely], hot[likely]
    hashes = window_hashes(words.hashes(11), window)[at]
    # a hot anchor's windows go by a hash of their own, another than that which they are compared by
    alone = window_hashes(words.hashes(12), window)[at] if hot.any() else hashes
    twice, first = _found_twice(grams[anchor], hashes)
    edges = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | hot[1:]]))
    size = np.diff(np.concatenate([edges, [len(at)]]))
    mask = np.bitwise_or.reduceat(twice.astype(np.int32) << (at - np.repeat(at[edges], size)).astype(np.int32), edges)
    send = np.logical_or.reduceat(~twice | first, edges)
    key = np.where(hot[edges], alone[edges], grams[anchor[edges]])
    key = np.where(send, key, mix(at[edges].astype(U))).view(np.int64)
    text = np.searchsorted(words.first, at[edges], side="right") - 1
    which = pa.array(text)
    place = (at[edges] - words.first[text]).astype(np.int32)
    sent_windows = _binary(hashes[np.repeat(send, size)], np.where(send, size, 0))
    columns = [pa.array(key), ids.take(which), keys.take(which), pa.array(place), pa.array(mask), sent_windows]
    return pa.RecordBatch.from_arrays(columns, names=["gram", "doc_id", "text_hash", "pos", "mask", "windows"])


def likely_windows(docs: DataFrame, bits: np.ndarray, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The runs of all texts, by bits that every task holds; see _runs."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = sent.value
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_hash")
            for k, j, data, offsets in pieces(*texts_of(batch.column("text")), PIECE):
                words = words_of(data, offsets)
                begins = _windows(words, window, gram)
                _, anchor, grams = begins
                likely, hot = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
                for twice_bits, hot_bits, slots in zip(*limits, _slots(grams[anchor], 8 * limits.shape[2]) if len(anchor) else (), strict=False):
                    likely &= _test(twice_bits, slots)
                    hot &= _test(hot_bits, slots)
                if likely.any():
                    yield _runs(words, begins, likely, hot, ids.slice(k, j - k), keys.slice(k, j - k), window)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, _RUNS)


@dataclass(frozen=True)
class Dealt:
    """How texts and counters are dealt where the sketch isn't broadcast; both grow with the corpus, so that the rows between them, one for each pair, stay few."""

    block_bytes: int
    slice_bits: int
    counter_bits: int

    @classmethod
    def of(cls, total: int) -> Dealt:
        steps = max(0, (total >> 37).bit_length() // 2)  # from 128 GB on, twice as large each time the corpus is four times as large
        return cls(min(64, 8 << steps) << 20, min(27, 22 + steps), max(22, int(total / 8).bit_length()))


def _anchor_slots(column: pa.Array, window: int, gram: int, dealt: Dealt) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of the sketch the distinct slots of a block's anchors, in order, and how often each is one."""
    found: list[np.ndarray] = []
    for _, _, data, offsets in pieces(*texts_of(column), PIECE):
        _, anchor, grams = _windows(words_of(data, offsets), window, gram)
        if len(anchor):
            found.append(grams[np.unique(anchor)])
    anchors = np.concatenate(found) if found else np.zeros(0, U)
    return [np.unique(slots, return_counts=True) for slots in _slots(anchors, 1 << dealt.counter_bits)]


def dealt_windows(docs: DataFrame, dealt: Dealt, total: int, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The runs of all texts, by a sketch whose slices stay on the executors; see _runs."""
    n = max(1, -(-total // dealt.block_bytes))
    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n))
    blocks = bucketed(docs.select("doc_id", "text", "text_hash", place.alias("block")), "repeats", "block", min(n, 20_000))
    hot_times, bits = HOT, dealt.slice_bits

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row, (slots, times) in enumerate(_anchor_slots(table.column("text"), window, gram, dealt)):
            part = slots >> bits
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = (slots[a:b] & ((1 << bits) - 1)).astype(np.int32).tobytes()
                rows.append((row << 40 | int(part[a]), key[0].as_py(), own, np.minimum(times[a:b], 0xFFFF).astype(np.uint16).tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["slice", "block", "slots", "times"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits, np.int32)
        slots = [np.frombuffer(x, np.int32) for x in table.column("slots").to_pylist()]
        for at, times in zip(slots, table.column("times").to_pylist(), strict=True):
            total[at] = np.minimum(total[at] + np.frombuffer(times, np.uint16), hot_times)
        said = [[np.packbits(total[at] >= limit).tobytes() for at in slots] for limit in (2, hot_times)]
        return pa.table([table.column("block"), table.column("slice"), pa.array(said[0], pa.binary()), pa.array(said[1], pa.binary()), pa.array([len(at) for at in slots], pa.int32())], ["block", "slice", "twice", "hot", "n"])

    def find(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        slices = answers.column("slice").to_numpy()
        order = np.argsort(slices)
        row, sizes = slices[order] >> 40, answers.column("n").to_numpy()[order]
        flags = []
        for name in ("twice", "hot"):
            packed = answers.column(name).to_pylist()
            each = [np.unpackbits(np.frombuffer(packed[k], np.uint8), count=n) for k, n in zip(order.tolist(), sizes.tolist(), strict=True)]
            flags.append([np.concatenate([x for x, r in zip(each, row, strict=True) if r == which] or [np.zeros(0, np.uint8)]) == 1 for which in range(len(_SEEDS))])
        known = _anchor_slots(texts.column("text"), window, gram, dealt)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        out = [pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=["gram", "doc_id", "text_hash", "pos", "mask", "windows"])]
        ids, keys = (texts.column(c).combine_chunks() for c in ("doc_id", "text_hash"))
        for k, j, data, offsets in pieces(*texts_of(texts.column("text")), PIECE):
            words = words_of(data, offsets)
            begins = _windows(words, window, gram)
            _, anchor, grams = begins
            likely, hot = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
            for which, slots in enumerate(_slots(grams[anchor], 1 << dealt.counter_bits) if len(anchor) else ()):
                at = np.searchsorted(known[which][0], slots)
                likely &= flags[0][which][at]
                hot &= flags[1][which][at]
            if likely.any():
                out.append(_runs(words, begins, likely, hot, ids.slice(k, j - k), keys.slice(k, j - k), window))
        return pa.Table.from_batches(out)

    asked = blocks.groupBy("block").applyInArrow(ask, "slice long, block long, slots binary, times binary")
    tasks = max(1, min(2 << max(0, dealt.counter_bits - bits), 20_000))
    answers = asked.repartition(tasks, "slice").groupBy("slice").applyInArrow(count, "block long, slice long, twice binary, hot binary, n int")
    answers = stored(answers, "repeated-slots")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(find, _RUNS)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The masks of runs, sorted by gram, with the windows that other runs hold as well.

    Runs with one gram wait for the last of them.  Only if they are many, and all one and the same window, are they
    answered before: two rows of it are enough to know, so one waits for those to come.
    """

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        gram, mask, windows = (table.column(c).combine_chunks() for c in ("gram", "mask", "windows"))
        raw = windows.to_pylist()
        size = np.array([len(x) // 8 for x in raw], np.int64)
        hashes = np.frombuffer(b"".join(raw), U)
        twice, _ = _found_twice(np.repeat(gram.to_numpy(), size), hashes)
        bit = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
        found = mask.to_numpy().copy()
        np.bitwise_or.at(found, np.repeat(np.arange(len(size)), size)[twice], (1 << bit[twice]).astype(np.int32))
        some = np.flatnonzero(found)
        starts = (table.column("pos").to_numpy()[some].astype(np.int64) << 32) | found[some]
        which = pa.array(some)
        return pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(which) for c in ("doc_id", "text_hash")] + [pa.array(starts)], names=["doc_id", "text_hash", "starts"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        gram = batch.column("gram").to_numpy()
        other = np.flatnonzero(gram != gram[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # the last gram may go on in the next batch
        if held and (cut or held[-1].column("gram")[-1].as_py() != gram[0]):
            yield flush([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield flush([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        if sum(map(len, held)) > HELD:
            rest = pa.Table.from_batches(held).filter(pc.greater(pc.binary_length(pa.Table.from_batches(held).column("windows")), 0))
            if len(rest) > 1 and len(rest.column("windows").unique()) == 1 and pc.binary_length(rest.column("windows")[0]).as_py() == 8:
                yield flush(held)
                held = rest.slice(len(rest) - 1).to_batches()
    if held:
        yield flush(held)


def drop_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, direct_bytes: int = 4 << 30) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words joined by a blank) of each row of ``docs``.

    Each word covered by a window of ``window`` words whose words also stand in a row anywhere else, in
    the same text or another row's, goes; windows are judged on the input.  Null and empty texts have no
    words.  Very long texts are searched whole.  Other columns are not looked at.  Rows that repeat doc_id and text repeat each other's windows and lose them all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= direct_bytes:
        counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << int(total / 8).bit_length()))
        runs = likely_windows(docs, sketch(docs, counters, window=window, gram=gram), window=window, gram=gram)
    else:
        runs = dealt_windows(docs, Dealt.of(total), total, window=window, gram=gram)
    answers = runs.repartition("gram").sortWithinPartitions("gram").mapInArrow(_answer, "doc_id long, text_hash long, starts long")
    covered = answers.groupBy("doc_id", "text_hash").agg(F.collect_set("starts").alias("starts"))
    covered = covered.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "starts")
    both = docs.join(covered, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("starts")
            for k, j, data, offsets in pieces(*texts_of(batch.column("text"))):
                words = words_of(data, offsets)
                n = np.diff(words.first)
                begin = np.zeros(len(words.start) + 1, np.int32)
                part = lists.slice(k, j - k)
                size = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
                packed = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                base, mask = np.repeat(words.first[:-1], size) + (packed >> 32), packed & 0xFFFFFFFF
                at = np.concatenate([base[mask >> bit & 1 == 1] + bit for bit in range(window - gram + 1)])
                np.add.at(begin, at, 1)
                np.add.at(begin, np.minimum(at + window, len(words.start)), -1)
                gone = np.cumsum(begin)[:-1] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[words.first[1:]] - removed[words.first[:-1]]
                raw, texts = data.tobytes(), []
                for t in range(j - k):
                    keep = words.first[t] + np.flatnonzero(~gone[words.first[t] : words.first[t + 1]])
                    texts.append(b" ".join(raw[a:b] for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, j - k), pa.array(n), pa.array(removed), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return both.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
