"""Quality rules: length, repetition, and divergence from what a language's prose looks like.

The divergence rules compare two histograms of a document with its language's reference by the
Jensen-Shannon distance (the root of the divergence in bits, 0 to 1): shares of character classes,
and shares of the language's most common words.  A short text strays from any reference by chance,
so texts under ``min_words`` words aren't judged and the limits shrink with the root of the length.  The
word limit stays below the distance of a text without one common word, wherever such a text is no chance.

All work is in DataFrame expressions within the scan's own stage: nothing is shuffled, and a
task holds one document at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._sql import paired, text_of, words_of
from ._store import stored

CLASSES = ("letters", "spaces", "capitals", "digits", "symbols", "marks")
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!\"'()+,\\-./:;=?@\\[\\\\\\]^_`{}~]"


@dataclass(frozen=True)
class Reference:
    """Shares of CLASSES in a language's prose, and its common words with their shares of all words."""

    classes: tuple[float, ...]
    words: dict[str, float]

    def wordless(self) -> tuple[float, float]:
        """Word distance of a text with none of the common words, and the length at which chance makes fewer than one in 1000 such."""
        share = min(sum(self.words.values()), 1.0)
        rest = 1 - share
        divergence = (share + math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest > 0 else 0)) / 2
        return math.sqrt(max(divergence, 0.0)), math.log(0.001) / math.log(rest) if 0 < rest < 1 else 0.0 if share else math.inf


# Shares measured on prose that is marked as good, rounded; for corpora without labels.
REFERENCES = {
    "en": Reference((0.795, 0.167, 0.0138, 0.0006, 0.0001, 0.0235), {"the": 0.055, "of": 0.029, "and": 0.023, "to": 0.017, "a": 0.014, "in": 0.012, "is": 0.0105, "that": 0.009, "it": 0.008, "for": 0.0075, "was": 0.007, "on": 0.0065}),
    "de": Reference((0.811, 0.154, 0.0123, 0.0006, 0.0001, 0.022), {"der": 0.055, "die": 0.029, "und": 0.023, "in": 0.017, "den": 0.014, "von": 0.0115, "zu": 0.01, "das": 0.0095, "mit": 0.008, "sich": 0.0075, "des": 0.007, "auf": 0.006}),
    "fr": Reference((0.799, 0.166, 0.0105, 0.0006, 0.0001, 0.0238), {"de": 0.055, "la": 0.03, "le": 0.022, "et": 0.017, "les": 0.014, "des": 0.012, "en": 0.011, "un": 0.0095, "du": 0.008, "une": 0.007, "que": 0.0065, "pour": 0.0065}),
    "es": Reference((0.803, 0.161, 0.012, 0.0008, 0.0001, 0.0231), {"de": 0.055, "la": 0.029, "que": 0.022, "el": 0.0165, "en": 0.014, "y": 0.0115, "los": 0.0105, "se": 0.009, "las": 0.0085, "del": 0.0075, "un": 0.007, "por": 0.0065}),
}


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    repeat_window: int = 8
    repeat_percent: int = 30
    min_words: int = 50
    class_limit: tuple[float, float] = (0.12, 1.0)  # base, and what is added over the root of the word count
    word_limit: tuple[float, float] = (0.20, 1.2)
    wordless_part: float = 0.95  # the word limit is at most this part of the distance of a text without common words
    references: dict[str, Reference] = field(default_factory=lambda: REFERENCES)


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; a zero share adds nothing."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    parts = F.zip_with(shares, reference, lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _by_language(references: dict[str, Reference], value: Callable[[Reference], list | float]) -> Column:
    """A literal for the document's language, null for an unknown one."""
    out = F.lit(None)
    for k, r in references.items():
        out = F.when(F.col("language") == k, F.lit(value(r))).otherwise(out)
    return out


def _without(text: Column, pattern: str) -> Column:
    """Number of characters that match."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), class_distance,
    word_distance (double), base_failed and kept (boolean).

    kept is false where base_failed: fewer than ``least_words`` words, or more than ``repeat_percent``
    of the words in windows of ``repeat_window`` words (a power of two) found twice or more.  Else it
    is false if a distance is over its limit (see Rules).  Texts under ``min_words`` words have no distances
    (null).  The class distance of a document of an unknown or null language is that from the nearest
    reference; it has no word distance.  A null text counts as an empty one.  Every row is judged by
    itself, so repeated rows and null ids come back as they are; columns of ``docs`` whose names
    clash with the new ones are replaced.  Texts are judged whole, however long.  The new columns come out of a
    generator of one row, so that a filter on them isn't copied into the steps below.
    """
    rest = [c for c in docs.columns]
    lang = F.col("lang") if "lang" in rest else F.lit(None).cast("string")
    d = docs.select(*(F.col(f"`{c}`").alias(f"in.{c}") for c in rest), text_of().alias("t"), lang.alias("language"))
    d = d.withColumn("words", words_of(F.col("t")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = d.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    apart = 1
    while apart < rules.repeat_window:
        d, apart = d.withColumn("h", paired("h", apart)), 2 * apart
    places = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), places))
    same = lambda x, k, other: F.get("sorted", k + other)["x"] == x["x"]
    found = F.filter("sorted", lambda x, k: F.coalesce(same(x, k, -1), F.lit(False)) | F.coalesce(same(x, k, 1), F.lit(False)))
    d = d.withColumn("found", F.sort_array(F.transform(found, lambda x: x["i"])))
    gaps = F.zip_with("found", F.slice("found", 2, F.greatest(F.size("found"), F.lit(1))), lambda a, b: F.least(F.lit(rules.repeat_window), F.coalesce(b - a, F.lit(rules.repeat_window))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))

    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": _without(F.col("t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_chars_": F.char_length("t"),
        "capitals": _without(F.col("t"), "[A-Z]"),
        "digits": _without(F.col("t"), "[0-9]"),
        "marks": _without(F.col("t"), MARKS),
    })
    n, known = F.greatest(F.col("n_chars_"), F.lit(1)).cast("double"), rules.references
    marked = F.col("capitals") + F.col("digits") + F.col("n_symbols") + F.col("marks")
    counts = [F.col("word_chars") - marked, F.col("n_chars_") - F.col("word_chars"), F.col("capitals"), F.col("digits"), F.col("n_symbols"), F.col("marks")]
    common = sorted({w for r in known.values() for w in r.words})
    d = d.withColumns({
        "class_shares": F.array(*(c / n for c in counts)),
        "class_reference": _by_language(known, lambda r: list(r.classes)),
        "word_list": _by_language(known, lambda r: list(r.words)),
        "word_reference": _by_language(known, lambda r: [*r.words.values(), 1 - sum(r.words.values())]),
        # the common words alone, each between two blanks: cheap to count in
        "common": F.concat(F.lit(" "), F.array_join(F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(common)), "  "), F.lit(" ")),
    })
    times = lambda w: (F.char_length("common") - F.char_length(F.replace(F.col("common"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.char_length(w) + 2)
    d = d.withColumn("word_shares", F.transform("word_list", lambda w: times(w) / F.greatest(F.col("n_words"), F.lit(1))))
    rest_share = F.greatest(1 - F.aggregate("word_shares", F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    nearest = F.array_min(F.transform(F.array(*(F.lit(list(r.classes)) for r in known.values())), lambda q: js_distance(F.col("class_shares"), q)))
    class_distance = F.when(F.col("class_reference").isNull(), nearest).otherwise(js_distance(F.col("class_shares"), F.col("class_reference")))
    word_distance = js_distance(F.concat("word_shares", F.array(rest_share)), F.col("word_reference"))
    long_enough = F.col("n_words") >= rules.min_words
    d = d.withColumns({
        "class_distance": F.when(long_enough, class_distance),
        "word_distance": F.when(long_enough, word_distance),
        "base_failed": (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")),
    })
    limit = lambda pair: pair[0] + pair[1] / F.sqrt(F.col("n_words").cast("double"))
    wordless, least = (_by_language(known, lambda r, k=k: r.wordless()[k]) for k in (0, 1))
    word_limit = F.least(limit(rules.word_limit), F.when(F.col("n_words") >= least, rules.wordless_part * wordless))
    over = F.coalesce(F.col("class_distance") > limit(rules.class_limit), F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed"]
    kept = ~F.col("base_failed") & ~over
    own = [F.col(f"`in.{c}`").alias(c) for c in rest if c not in (*new, "kept")]
    return d.select(*own, F.stack(F.lit(1), *new, kept).alias(*new, "kept"))


def _top_words(docs: DataFrame, top: int) -> dict[str, dict[str, float]]:
    """The most frequent lower-cased words of each language with their shares of all words; of equal ones the first."""
    words = docs.select("lang", F.explode(F.transform(words_of(text_of()), lambda w: F.lower(w))).alias("w"))
    counts = stored(words.groupBy("lang", "w").agg(F.count("*").alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    order = [F.desc("n"), F.col("w")]
    # in two steps, so that no task has all words of a language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("w"), F.lit(256))).orderBy(*order)
    some = counts.withColumn("k", F.row_number().over(part)).where(F.col("k") <= top)
    best = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= top)
    out: dict[str, dict[str, float]] = {lang: {} for lang in totals}
    for r in best.sort("lang", "k").collect():
        out[r["lang"]][r["w"]] = r["n"] / totals[r["lang"]]
    return out


def measured(docs: DataFrame, rules: Rules = Rules(), *, top: int = 12, share: float = 0.999, slack: float = 0.0) -> Rules:
    """``rules`` with references and limits measured on ``docs`` (text, lang), prose that is known to be good.

    Each language's reference has the shares of character classes over all its texts and its ``top`` most frequent
    words.  The base of each limit is such that about ``share`` of the texts are within it, and larger by ``slack`` over the
    root of their number, as few texts tell little of how far good ones go.  Rows without a language
    or a text count for nothing; a language without a word gets no reference, and without texts of ``min_words``
    words the limits stay.  One row a language and word reaches the driver: languages should be few.
    """
    docs = docs.where("lang is not null").select("lang", text_of().alias("text"))
    chars, words = F.char_length("text"), F.char_length(F.array_join(words_of(F.col("text")), ""))
    found = [_without(F.col("text"), p) for p in ("[A-Z]", "[0-9]", SYMBOLS, MARKS)]
    counts = [words - sum(found[1:], found[0]), chars - words, *found]
    sums = docs.groupBy("lang").agg(*(F.sum(c).alias(k) for k, c in zip(CLASSES, counts, strict=True)), F.sum(chars).alias("chars"))
    frequent = _top_words(docs, top)
    references = {r["lang"]: Reference(tuple(r[c] / r["chars"] for c in CLASSES), frequent[r["lang"]]) for r in sums.collect() if r["lang"] in frequent}
    if not references:
        return rules
    judged = apply_rules(docs, replace(rules, references=references))
    judged = stored(judged.select("n_words", "base_failed", "class_distance", "word_distance"), "judged").where("not base_failed")
    within = F.max if share >= 1 else lambda x: F.percentile_approx(x, share, 100_000)
    over = lambda column, limit: within(F.col(column) - limit[1] / F.sqrt("n_words"))
    *base, n = judged.agg(over("class_distance", rules.class_limit), over("word_distance", rules.word_limit), F.count("class_distance")).first()
    limits = [old if b is None else (max(b, 0.0) + slack / math.sqrt(n), old[1]) for b, old in zip(base, (rules.class_limit, rules.word_limit), strict=True)]
    return replace(rules, references=references, class_limit=limits[0], word_limit=limits[1])


def labelled_rules(docs: DataFrame, labels: DataFrame, *, most: int | None = None) -> Rules:
    """Rules measured on the texts of ``docs`` (doc_id, text, lang) that ``labels`` (doc_id, quality) marks as good.

    Labels whose crc32(doc_id as text) mod 4 is 2 are held out.  All others count; a caller who wants fewer gets the ``most``
    whose ids have the least hashes.  All texts taken lie within the limits, with some slack.  Without good rows the rules
    are those that came with this module.
    """
    learned = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    good = labels.where(learned & (F.col("quality") == 1)).select("doc_id").distinct()
    if most is not None:
        good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    good = good.hint("merge")  # whatever the size: ids that are sent to every executor would grow with the labels
    texts = docs.where(learned & F.col("lang").isNotNull()).select("doc_id", "text", "lang")  # others need not travel to the join
    return measured(stored(texts.join(good, "doc_id", "left_semi").select("text", "lang"), "good"), share=1.0, slack=0.5)
