"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import pseudonymize

    # a fixed key makes the query's result repeatable; a user passes a secret one
    return pseudonymize(_documents(spark, sf_dir), b"larkspur example key")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import flag

    return flag(_documents(spark, sf_dir).select("doc_id", "text"), _benchmark(spark, sf_dir)).drop("text")


def op3_sentencepiece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_pieces import encode, read_model

    rows = encode(_documents(spark, sf_dir), read_model(spark))
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "parity")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_texts

    return score_texts(_documents(spark, sf_dir))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, labelled_rules

    docs = _documents(spark, sf_dir)
    rules = labelled_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).drop("text", "lang", "source", "n_chars")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import drop_repeats

    return drop_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dup import bitmaps, drop_lines

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return drop_lines(docs, bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(vectors, anchors="vec_id % 100 = 0")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan, train

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, train(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    rows, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    said = hashlib.sha256(",".join(str(x) for x in codebooks.ravel().tolist()).encode()).hexdigest()
    # labels are few: one row each
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    both = rows.join(errors, F.col("label").eqNullSafe(F.col("l")))
    return both.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(said).alias("codebooks_sha256"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 counts in each text, before any distance."""
    rows = op7_quality_rules(spark, sf_dir)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 must say of each text, whether equal texts share a shard, and whether its shard's slots count from 0 without a gap."""
    rows = op10_sharding(spark, sf_dir)
    groups = rows.groupBy("text_crc32", "size").agg((F.count_distinct("shard") == 1).alias("together"))
    n, last = F.count("*"), F.max("slot") + 1
    shards = rows.groupBy("shard").agg(((n == last) & (n == F.count_distinct("slot")) & (F.min("slot") == 0)).alias("gapless"))
    both = rows.join(groups, ["text_crc32", "size"]).join(shards, "shard")
    return both.select("doc_id", "size", "text_crc32", "law", "together", "gapless", (F.col("shard").between(0, 39) & F.col("grown_shard").isNull()).alias("in_range"))


def held_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 must say of each row beside its score, and whether the score is one and fits the prediction."""
    rows = op6_quality_classifier(spark, sf_dir)
    fits = F.col("score").between(0, 1) & ((F.col("score") >= 0.7).cast("int") == F.col("predicted"))
    return rows.select("doc_id", "held_out", fits.alias("fits"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often op12's patterns match, and whether anything was added to them."""
    rows = op12_secret_scan(spark, sf_dir)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", (F.size(F.filter(F.split("spans", ","), lambda s: s != "")) >= F.col("n_assign") + F.col("n_access") + F.col("n_hex")).alias("all_there"))


def language_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 says of each text beside the model's score."""
    rows = op4_lm_scoring(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_sentencepiece_encode_decode": op3_sentencepiece_encode_decode,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secret_scan": op12_secret_scan,
    "op13_vector_codes": op13_vector_codes,
    "quality_counts": quality_counts,
    "language_base": language_base,
    "secret_counts": secret_counts,
    "shard_facts": shard_facts,
    "held_out_rows": held_out_rows,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of a doc_id's digits, a bit at a time
_CRC = """xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substring(doc_id::varchar, i, 1))::bigint),
          lambda c, x: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, x)), 4294967295::bigint))"""

_WHOLE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_FLOORS = "list_transform(embedding, lambda x: floor(256 * x::double))"


def _lloyd(rounds: int, parts: int = 16, entries: int = 64) -> str:
    """The steps of op13 in SQL: assignments and means in turn, one pair of subqueries a round."""
    nearest = """near{k} AS (SELECT i, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
            SELECT i, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) ** 2)) AS d FROM cut JOIN books{k} USING (p)) GROUP BY i, p)"""
    means = """books{n} AS (SELECT p, e, coalesce(m, c) AS c FROM books{k} LEFT JOIN (
            SELECT p, e, list(m ORDER BY z) AS m FROM (SELECT p, e, z, floor(sum(x) / count(*)) AS m
                FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS z FROM cut JOIN near{k} USING (i, p)) GROUP BY p, e, z) GROUP BY p, e) USING (p, e))"""
    steps = [f"""rows AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, {_FLOORS} AS v FROM embeddings WHERE {_WHOLE}),
        cut AS (SELECT i, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM (SELECT i, v, unnest(range({parts})) AS p FROM rows)),
        books0 AS (SELECT p, i - 1 AS e, v AS c FROM cut WHERE i <= {entries})"""]
    for k in range(rounds):
        steps += [nearest.format(k=k), means.format(k=k, n=k + 1)]
    steps.append(nearest.format(k=rounds))
    return "WITH " + ",\n        ".join(steps) + f""",
        coded AS (SELECT i, string_agg(lower(printf('%02x', e::int)), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM near{rounds} GROUP BY i),
        said AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' ORDER BY p, e)) AS h FROM books{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, h AS codebooks_sha256 FROM coded JOIN rows USING (i) CROSS JOIN said"""


ORACLES: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH kept AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label END AS label, {_FLOORS} AS v
                      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_WHOLE}),
        scored AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::bigint AS s FROM kept a JOIN kept b ON a.id % 100 = 0 AND a.id <> b.id),
        near AS (SELECT a, b AS p, s AS t FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT a AS anchor_id, p AS positive_id, (row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b))::int AS rank, b AS negative_id, t AS positive_score, s AS negative_score
        FROM near JOIN scored USING (a) WHERE NOT same AND 80 * t <= 100 * s AND 100 * s <= 100 * t QUALIFY rank <= 5""",
    "op13_vector_codes": _lloyd(2),
    "op5_minhash_near_dedup": f"""
        WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                                     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM texts),
        sizes AS (SELECT doc_id, len(shingles) AS n FROM sets),
        each AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(doc_id, c) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT b, c FROM reached JOIN ways ON a = doc_id WHERE c < b)
        SELECT doc_id, any_value(n)::bigint AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
        FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op8_substring_dedup": f"""
        WITH texts AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM texts)),
        often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM windows JOIN often USING (w)),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(words)::bigint AS n_words, (len(words) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)""",
    "quality_counts": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts)),
        often AS (SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM windows JOIN often USING (doc_id, w)) GROUP BY doc_id)
        SELECT doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
               coalesce(n, 0)::bigint AS n_repeat_words, len(words) < 20 OR 100 * coalesce(n, 0) > 30 * len(words) AS base_failed
        FROM texts JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)""",
    "held_out_rows": f"SELECT doc_id, {_CRC} % 4 = 2 AS held_out, true AS fits FROM documents",
    "shard_facts": """
        WITH tables AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, n::bigint)) AS crc),
        texts AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents)
        SELECT doc_id, (n + 16)::bigint AS size, 'bytes' AS law, true AS together, true AS gapless, true AS in_range,
               xor(4294967295, list_reduce(list_transform(range(n), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint)) AS text_crc32
        FROM texts, tables""",
    "secret_counts": """
        WITH found AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS a,
                              regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') AS k, regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') AS h FROM documents)
        SELECT doc_id, len(list_filter(a, lambda x: length(x) >= 8))::bigint AS n_assign, len(list_filter(k, lambda x: length(x) >= 16))::bigint AS n_access,
               len(list_filter(h, lambda x: length(x) >= 32))::bigint AS n_hex, true AS all_there FROM found""",
    "language_base": f"""
        WITH texts AS (SELECT doc_id, list_append({_WORDS.format(_LOWER)}, '') AS tokens, {_CRC} % 7 = 2 AS held_out FROM documents),
        each AS (SELECT doc_id, held_out, unnest(tokens) AS token FROM texts),
        counts AS (SELECT token, count(*) AS c FROM each WHERE NOT held_out GROUP BY token),
        whole AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::bigint AS train_tokens,
               round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
        FROM each LEFT JOIN counts USING (token) CROSS JOIN whole GROUP BY doc_id, held_out""",
    "op9_line_dedup": """
        WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        every AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
        keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM every),
        common AS (SELECT k AS c FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common ON k = c GROUP BY doc_id""",
}
