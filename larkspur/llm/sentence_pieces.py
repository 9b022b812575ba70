"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field (its wire format is public); normaliser, blank marker,
scores or merges, and byte fallback are rebuilt as a ``tokenizers.Tokenizer``.  Texts are encoded in
batches with all threads a task has.  Where no piece of the model goes on past a blank (checked when
it is read), a text's ids are those of its words in turn, so each distinct word is encoded once and
kept in a bounded cache.  ``parity`` says for each text whether the sentencepiece library itself gives
the same ids, for all its words or for the whole text; the rebuilt tokenizer is checked, not trusted.

A model is one small file; its bytes, at most ``MODEL_BYTES``, are broadcast to the tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import Words, give_back, pieces, texts_of

MARK = "▁"
MODEL_BYTES = 64 << 20
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at, out, shift = at + 1, out | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + size])[0]
            at += size
        else:
            raise ValueError(f"wire type {kind} isn't in use")


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix: bool

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse_model(data: bytes) -> PieceModel:
    found, trainer, normal = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            found.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    return PieceModel(tuple(found), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)), bool(trainer.get(24, 0)))


def build_tokenizer(model: PieceModel):
    """The ``tokenizers.Tokenizer`` that encodes and decodes as ``model`` does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("word and character models have no tokenizers counterpart")
    if model.suffix or not model.escape:
        raise ValueError("a blank marker behind words, or none, isn't supported")
    names = [p[0] for p in model.pieces]
    plain = {p[0] for p in model.pieces if p[2] in (NORMAL, USER)}
    if model.kind == UNIGRAM:
        low = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0) - 1e4
        core = models.Unigram([(p, s if k in (NORMAL, USER) else low) for p, s, k in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        ids = {p: i for i, p in enumerate(names)}
        by_score = sorted((p for p in model.pieces if p[2] == NORMAL and len(p[0]) > 1), key=lambda p: (-p[1], ids[p[0]]))
        merges = [(p[:k], p[k:]) for p, _, _ in by_score for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        core = models.BPE(ids, merges, unk_token=names[model.unknown], byte_fallback=model.byte_fallback, fuse_unk=True)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(f"[ {MARK}]+"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p in plain):
        # no piece goes on past a blank, so words can be told apart first, and the model's cache helps
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    out.add_tokens([AddedToken(p, normalized=True) for p, _, k in model.pieces if k == USER])
    return out


def _blank_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The pieces of texts from one run of blanks to the next, without the blank that the marker stands for."""
    blank = data == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = True
    start = np.flatnonzero(begins)
    first = np.zeros(len(data), bool)
    first[firsts] = True
    return Words(data, start + ~first[start], np.concatenate([start[1:], np.full(min(1, len(start)), len(data))]), np.searchsorted(start, offsets))


class Codec:
    """A model's tokenizer beside the sentencepiece library, with the words encoded so far."""

    CACHED = 1 << 17

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = parse_model(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.words = build_tokenizer(self.model)
        self.by_word = self.words.pre_tokenizer is not None and not self.model.squeeze and not self.model.charsmap and self.model.dummy_prefix
        self.words.normalizer = self.words.pre_tokenizer = None
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.forget()

    @cached_property
    def tokenizer(self):
        """For whole texts; where words are enough few tasks need it, and a worker is spared its memory."""
        return build_tokenizer(self.model)

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # a word's hash -> its place in the next three
        self.pool, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.same = np.zeros(0, bool)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        found = [x.ids for x in self.words.encode_batch_fast([MARK + w.replace(" ", MARK) for w in words], add_special_tokens=False)]
        # the library gives no ids for no text, where the words before it have put a blank
        same = [a == b or not w for w, a, b in zip(words, found, self.library.encode(words, num_threads=1), strict=True)]
        self.known.update(zip(hashes, range(len(self.size), len(self.size) + len(words)), strict=True))
        size = np.array([len(x) for x in found], np.int64)
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size, self.same = np.concatenate([self.size, size]), np.concatenate([self.same, np.array(same, bool)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.int32)])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the library gives the same."""
        if not self.by_word:
            ids = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return ids, [a.tolist() == b for a, b in zip(ids, self.library.encode(texts, num_threads=1), strict=True)]
        raw = [t.encode() for t in texts]
        words = _blank_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        distinct, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > self.CACHED:
            self.forget()
        hashes = distinct.tolist()
        if new := [k for k, h in enumerate(hashes) if h not in self.known]:
            data, spans = words.data.tobytes(), zip(words.start[at[new]].tolist(), words.end[at[new]].tolist(), strict=True)
            self._learn([hashes[k] for k in new], [data[a:b].decode() for a, b in spans])
        place = np.array([self.known[h] for h in hashes], np.int64)[which]
        size = self.size[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(self.begin[place] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[words.first]
        ids = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        wrong = np.concatenate([[0], np.cumsum(~self.same[place])])[words.first]
        same = (np.diff(wrong) == 0).tolist()
        for k, text in enumerate(texts):
            if MARK in text:  # the marker itself in a text counts as a blank: told apart only in the whole text
                ids[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                same[k] = ids[k].tolist() == self.library.encode(text)
        return ids, same

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of some ids: the bytes of their pieces in turn; sequences that aren't UTF-8 are left to the tokenizer."""
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        size, begin = np.diff(self.piece_ends)[flat], self.piece_ends[:-1][flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_bytes[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
        out = []
        for k, x in enumerate(ids):
            try:
                text = data[cuts[k] : cuts[k + 1]].decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(x.tolist(), skip_special_tokens=False))
        return out


@lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def read_model(spark: SparkSession, path: str = DEFAULT_MODEL) -> bytes:
    """A model's bytes, from any store that Spark reads."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if len(data) > MODEL_BYTES:
        raise ValueError(f"a model of {len(data)} bytes is over the bound of {MODEL_BYTES}")
    return data


def encode(docs: DataFrame, model: bytes, *, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens long, ids array<int>, decoded string, parity boolean), one row per row of ``docs``.

    ``decoded`` is the text that the ids give back; ``parity`` whether the sentencepiece library gives
    the same ids.  A null text gives no ids and a null ``decoded``; an empty one gives no ids and an
    empty one.  Repeated rows and null keys come back as they are.  Texts are encoded whole: those of a batch
    about 1 MB at a time, a longer one by itself.  Other columns of ``docs`` are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            column = batch.column("text")
            data, offsets = texts_of(column)
            for k, j, _, _ in pieces(data, offsets, 1 << 20):
                part = column.slice(k, j - k)
                ids, same = own.encode(pc.fill_null(part, "").to_pylist())
                decoded = own.decode(ids)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                missing = part.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(k, j - k), pa.array(np.diff(ends)), lists, pa.array(decoded, pa.string(), mask=missing), pa.array(same, pa.bool_())], names=[key, "n_tokens", "ids", "decoded", "parity"])
        own.forget()
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, decoded string, parity boolean")


def decode(rows: DataFrame, model: bytes, *, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text): the texts that arrays of ids give; null for a null array."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = own.decode([np.array(x or [], np.int32) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
