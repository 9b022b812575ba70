"""Each operator against brute force on a small table, and on rows that are odd in every way."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, language_model, line_dup, near_dup, quality_model, quality_rules, repeats, sentence_pieces, sharding, surrogates
from larkspur.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{k % 977} and{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One line"), (4, "One line"), (None, "no id here at all"), (None, None), (5, LONG), (6, LONG), (7, "naïve ▁ text\n\nnaïve ﬁ 日本語 🎉\x00"), (8, "a b c d e f g h " * 40)]
OPERATORS = {
    "op1": lambda d: surrogates.pseudonymize(d, b"key"),
    "op2": lambda d: decontaminate.flag(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "op3": lambda d: sentence_pieces.encode(d, sentence_pieces.read_model(d.sparkSession)),
    "op4": language_model.score_texts,
    "op5": near_dup.near_duplicates,
    "op6": lambda d: quality_model.classify(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "op7": quality_rules.apply_rules,
    "op8": repeats.drop_repeats,
    "op9": lambda d: line_dup.drop_lines(d, line_dup.bitmaps(d, min_docs=2)),
    "op10": sharding.shard,
}


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), *(F.lit(1).alias(c) for c in ("n", "pos", "kept", "size", "h", "row", "block", "a", "b", "part", "count")))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_come_back(spark, name):
    got = OPERATORS[name](odd(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](odd(spark, [])).collect() == []


def result(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}


def test_surrogates(spark, texts):
    given = "Mrs. Anna Schmidt met Mr. John O'Neil; Schmidt paid 4111 1111 1111 1111, +1 (017) 555-7713, a.b@mail.example.com, a.b@mail.example.com."
    new, kinds = surrogates.replaced(given, lambda e: surrogates.surrogate(b"k", *e, 0))
    again, _ = surrogates.replaced(given, lambda e: surrogates.surrogate(b"k", *e, 0))
    other, _ = surrogates.replaced(given, lambda e: surrogates.surrogate(b"other", *e, 0))
    assert new == again != other and len(kinds) == 9
    first, last = re.match(r"Mrs\. (\w+) (\w+) met", new).groups()
    assert first.endswith("a") and new.count(last) == 2 and not re.search("Schmidt|Anna|O'Neil|555-7713|4111 1111", new)
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert surrogates._luhn(card) and len(set(re.findall(r"\S+@\S+\.com", new))) == 1
    got = result(spark, "op1_pii_surrogates")
    private = re.compile(r"[\w.]+\.\d+@[\w.]+|\(\d{3}\) \d{3}-\d{4}|(?:\d+\.){3}\d+|\d{16}|[0-9a-f]{40}")
    for i, t in texts.items():
        assert not any(x in got[i].text for x in private.findall(t))
        assert got[i].n_entities or got[i].text == t


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    entities = spark.createDataFrame([("ip", f"10.0.{k % 2}.{k // 2 + 1}") for k in range(400)], "kind string, value string")
    drawn = surrogates.assign(entities, b"k").collect()
    real = {(r["kind"], r["value"]) for r in drawn}
    assert len({r["surrogate"] for r in drawn}) == 400 and not any((r["kind"], r["surrogate"]) in real for r in drawn)
    dense = spark.createDataFrame([("secret", f"{k:x}") for k in range(6)], "kind string, value string")
    assert len({r["surrogate"] for r in surrogates.assign(dense, b"k").collect()}) == 6


def test_formats_with_few_values_are_widened(spark):
    assert surrogates.mentions("Password: ________ or key = ----------, to _@-.com") == []
    given = ["Mrs A Smith", "Mr J Smith and Mr K Jones", "Госпожа Щ Ы", "password: пароль-密码密码", "Password: ________"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.pseudonymize(docs, b"key").collect()}
    assert got[4].text == given[4] and [got[k].n_entities for k in range(5)] == [2, 4, 2, 1, 0]
    names = {w for k in range(3) for w in got[k].text.split() if w not in ("Mrs", "Mr", "and", "Госпожа")}
    assert len(names) == 7 and not names & {*"AJKЩЫ", "Smith", "Jones"} and not set("парольпароль密码") & set(got[3].text)
    full = [("secret", f"{k:x}") for k in range(16)] + [("ip", f"192.168.{k // 254 + 1}.{k % 254 + 1}") for k in range(45_000)]
    drawn = surrogates.assign(spark.createDataFrame(full, "kind string, value string"), b"k").collect()
    assert len(drawn) == len({r.surrogate for r in drawn}) == len(full) and not {r.surrogate for r in drawn} & {v for _, v in full}


def test_widened_surrogates_keep_kind_and_layout():
    real = {"phone": "+1 (017) 555-7713", "card": "4111 1111 1111 1111", "ssn": "123-45-6789", "iban": "DE89 3704 0044 0532 0130 00", "email": "Al@x.com", "secret": "abc-DEF1", "ip": "8.8.8.8", "name:m": "J", "name:f": "A"}
    for kind, mention in real.items():
        value = surrogates._canonical(kind, mention)
        for attempt in range(surrogates.NARROW + 6):
            new = surrogates.surrogate(b"k", kind, value, attempt)
            laid = surrogates._laid_out(kind, mention, new)
            assert kind == "ip" or len(laid) == len(mention) + (1 << attempt - surrogates.NARROW if attempt >= surrogates.NARROW else 0)
            assert surrogates._canonical(kind, laid) == new
            if kind == "card":
                assert surrogates._luhn(new)


def test_masks_hit_every_window_with_two_substitutions():
    seeds = decontaminate.Seeds()
    for k in range(seeds.substitutions + 1):
        for gone in itertools.combinations(range(seeds.window), k):
            assert any(not {s + p for p in mask} & set(gone) for mask in seeds.masks for s in range(seeds.window - seeds.span + 1))


def test_decontamination(spark, texts):
    token = re.compile(r"[^\W_]+")
    items = {r.item_id: token.findall(r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = result(spark, "op2_benchmark_decontamination")
    grams = collections.defaultdict(list)
    for words in items.values():
        for k in range(len(words) - 12):
            grams[words[k]].append(words[k : k + 13])
    windows = [g for v in grams.values() for g in v]
    for i, t in texts.items():
        words = token.findall(t.lower())
        near = any(sum(a == b for a, b in zip(g, words[k : k + 13], strict=True)) >= 11 for k in range(len(words) - 12) for g in (windows if len(words) < 150 else grams.get(words[k], ())))
        assert not near or got[i].contaminated
        assert not got[i].contaminated or len(words) >= 150 or near


def test_substituted_passage_and_both_joins(spark):
    words = [f"w{k}" for k in range(40)]
    changed = [f"x{k}" if k % 8 == 3 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(["a b c", *changed, "d"])), (2, " ".join(words[::2])), (3, None)], "doc_id long, text string")
    tests = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    for seeds in (decontaminate.Seeds(), decontaminate.Seeds(broadcast_rows=0)):
        assert [r.doc_id for r in decontaminate.contaminated(docs, tests, seeds).collect()] == [1]


def test_sentence_pieces(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.DEFAULT_MODEL)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts.values(), *(t for _, t in ODD if t), "<s> <0x41> <unk>", "  a  b ", "é" * 50])], "doc_id long, text string")
    model = sentence_pieces.read_model(spark)
    coded = sentence_pieces.encode(rows, model)
    given = {r.doc_id: r.text for r in rows.collect()}
    for r in coded.collect():
        assert r.parity and r.ids == library.encode(given[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded == given[r.doc_id].replace("▁", " ")
    assert {r.doc_id: r.text for r in sentence_pieces.decode(coded, model).collect()} == {i: t.replace("▁", " ") for i, t in given.items()}


def field(number, value):
    def varint(n):
        return bytes([n & 0x7F | 0x80]) + varint(n >> 7) if n > 0x7F else bytes([n])

    import struct

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model_with_byte_fallback():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in (("▁", -3.0), ("▁the", -1.5), ("he", -2.0), ("t", -4.0), ("h", -4.1), ("e", -4.2), ("▁cat", -2.5), ("s", -3.3)))]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(3, 1) + field(4, 0) + field(5, 1))
    codec = sentence_pieces.codec(data)
    given = ["the cats", "the  the", "hehe caté t", " the ", "", "the"]
    ids, same = codec.encode(given)
    assert all(same) and [x.tolist() for x in ids] == codec.library.encode(given) and codec.decode(ids) == given


def test_language_model(spark, texts):
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, v in tokens.items() if not held[i] for w in v)
    total, got = sum(counts.values()), result(spark, "op4_lm_scoring")
    for i, v in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(v), sum(counts[w] > 0 for w in v), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in v), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_near_duplicates(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = result(spark, "op5_minhash_near_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), least[i], least[i] == i) for i, s in sets.items()}


def test_quality_model_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_quality_classifier"](spark, data).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_quality_rules(spark, texts):
    got = result(spark, "op7_quality_rules")
    for i, t in texts.items():
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often, covered = collections.Counter(windows), set()
        for k, w in enumerate(windows):
            covered |= set(range(k, k + 8)) if often[w] > 1 else set()
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.kept and r.base_failed)


def test_texts_without_common_words_are_dropped(spark):
    rows = []
    for lang, r in quality_rules.REFERENCES.items():
        for n in (50, 70, 88, 90, 120):
            rows.append((lang, n, " ".join(f"verb{chr(97 + k % 26)}{chr(97 + k // 26)}r" for k in range(n)), False))
            common = list(r.words)
            rows.append((lang, n, " ".join(common[k // 5 % len(common)] if k % 5 == 0 else f"verb{chr(97 + k % 26)}{chr(97 + k // 26)}r" for k in range(n)), True))
    docs = spark.createDataFrame(rows, "lang string, n int, text string, good boolean")
    got = quality_rules.apply_rules(docs, quality_rules.Rules(class_limit=(1.0, 1.0))).collect()
    assert len(got) == 40 and not any(r.base_failed for r in got) and [(r.lang, r.n, r.kept) for r in got if r.kept != r.good] == []
    for lang, r in quality_rules.REFERENCES.items():
        assert all(math.isclose(x.word_distance, r.wordless()[0], rel_tol=1e-9) for x in got if x.lang == lang and not x.good)
    # by chance a short text has none of a reference's rare words, so no text is dropped for that alone
    rare = {"en": quality_rules.Reference(quality_rules.REFERENCES["en"].classes, {"heretofore": 0.001})}
    got = quality_rules.apply_rules(docs.where("lang = 'en' and n = 50"), quality_rules.Rules(class_limit=(1.0, 1.0), references=rare)).collect()
    assert len(got) == 2 and all(r.kept for r in got)


def test_repeats(spark, texts):
    words = {i: WORD.findall(t) for i, t in texts.items()}
    often = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = result(spark, "op8_substring_dedup")
    for i, w in words.items():
        gone = {x for k in range(len(w) - 34) if often[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_repeats_where_the_sketch_is_full(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_test", lambda bits, slots: slots >= 0)
    test_repeats(spark, {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()})


def test_lines(spark, texts):
    key = lambda x: x.translate(LOWER).strip(SPACE)
    docs = collections.Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    got = result(spark, "op9_line_dedup")
    for i, t in texts.items():
        lines = t.split("\n")
        kept = [x for x in lines if not key(x) or docs[key(x)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_first_lines_stay_if_asked(spark):
    docs = spark.createDataFrame([(2, "x\nsame\ny"), (1, "same\nz\nSAME "), (3, "same")], "doc_id long, text string")
    got = line_dup.drop_lines(docs, line_dup.bitmaps(docs, min_docs=2, keep_first=True))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "same\nz", 2: "x\ny", 3: ""}


def test_shards(spark, texts):
    got = result(spark, "op10_sharding")
    size, rows, shards = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for i, t in texts.items():
        r = got[i]
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes")
        size[r.shard] += r.size
        rows[r.shard].append(r.slot)
        shards[t].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in rows.values()) and all(len(v) == 1 for v in shards.values()) and max(rows) < 40
    order = spark.read.parquet(f"{DATA}/documents.parquet").groupBy(F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), F.octet_length("text").alias("n")).agg(F.sum(F.octet_length("text") + 16).alias("size")).orderBy("h", "c", "n")
    groups = [r["size"] for r in order.collect()]

    def runs(capacity):
        n, left = 0, 0
        for g in groups:
            n, left = (n, left - g) if g <= left else (n + 1, capacity - g)
        return n

    capacity = next(c for c in range(max(groups), sum(groups)) if runs(c) <= 40)
    assert max(size.values()) == capacity
