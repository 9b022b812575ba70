"""Benchmark decontamination with spaced-seed hashes.

A mask names the token positions of a window that are hashed; the others are ignored, so a
substitution there changes nothing.  Windows of the test items and of the training documents are
joined on their masked hashes; around each hit the two texts are laid side by side, and the hit
counts if ``window`` tokens that hold it agree in all but ``substitutions`` places.  The default
masks hit every window of 13 tokens with any two of them replaced (`tests/llm` goes through all).  An item
of 8 to 12 tokens has no such window: its hits count if the document holds the whole item as it is.

A key that more than ``crowd`` passages share, as a template's words are, would be laid beside all of them at each place of each
document.  There the verification is itself a join: both sides hash every choice of agreeing tokens that
would make an overlap (``_choices``), and equal hashes are the overlap, so passages with one hash are one row.

Tokens are runs of letters and digits of the lower-cased text.  The hashes of the test side are
broadcast only if there are at most ``broadcast_rows`` of them; beyond, the document windows are
joined by a shuffle, in which Spark's runtime filter can prune them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._sql import text_of
from ._store import stored

_DOC = ("doc_id", "text_hash")


@dataclass(frozen=True)
class Seeds:
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
    window: int = 13
    substitutions: int = 2
    broadcast_rows: int = 2_000_000  # of 8 bytes each
    crowd: int = 32  # passages of a key that are laid beside a document's tokens one by one

    @property
    def span(self) -> int:
        return max(map(max, self.masks)) + 1

    @property
    def margin(self) -> int:
        """How far a window that holds a hit can reach to either side of it."""
        return max(self.window - self.span, 0)


def token_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _windows(rows: DataFrame, seeds: Seeds) -> DataFrame:
    """``rows`` (with ``h``, token hashes), once for each place ``at`` and ``mask``, with its ``key``."""
    places = F.when(F.size("h") >= seeds.span, F.sequence(F.lit(0), F.size("h") - seeds.span))
    each = rows.select("*", F.explode(places).alias("at"))
    keys = [F.xxhash64(F.lit(k), *(F.get(F.col("h"), F.col("at") + p) for p in mask)) for k, mask in enumerate(seeds.masks)]
    return each.select("*", F.posexplode(F.array(*keys)).alias("mask", "key"))


def _around(seeds: Seeds, prefix: str) -> list[Column]:
    """The tokens around a hit, and how many of them come before it."""
    before = F.least(F.col("at"), F.lit(seeds.margin))
    return [F.slice("h", F.col("at") - before + 1, before + seeds.span + seeds.margin).alias(f"{prefix}_near"), before.alias(f"{prefix}_before")]


def _verified(seeds: Seeds) -> tuple[Column, Column]:
    """Where the two texts agree around a hit, as ``same``, and whether that is an overlap.

    It is one if ``window`` neighbours agree but for the substitutions.  ``test_near`` is shorter than that only
    if it is a whole item of fewer tokens; then all of these must agree.
    """
    left = F.least("doc_before", "test_before")
    size = F.least(F.size("doc_near") - F.col("doc_before"), F.size("test_near") - F.col("test_before")) + left
    cut = lambda side: F.slice(f"{side}_near", F.col(f"{side}_before") - left + 1, size)
    same = F.zip_with(cut("doc"), cut("test"), lambda a, b: (a == b).cast("int"))
    agree = lambda k: F.aggregate(F.slice("same", k + 1, seeds.window), F.lit(0), lambda s, x: s + x) >= seeds.window - seeds.substitutions
    places = F.sequence(F.lit(0), F.size("same") - seeds.window)
    whole = (F.size("test_near") < seeds.window) & (F.size("same") == F.size("test_near")) & F.forall("same", lambda x: x == 1)
    return same, F.when(F.size("same") >= seeds.window, F.exists(places, agree)).otherwise(whole)


def _choices(spark: SparkSession, seeds: Seeds) -> DataFrame:
    """(mask, choice, first, end, whole, places): which tokens around a hit of a mask make an overlap if they agree.

    Places count from the hit's first token; the tokens from ``first`` to ``end`` must be there on both sides.  For each
    window that holds the hit these are all its tokens but two that the mask ignores or doesn't reach; for items
    shorter than a window (``whole``) all of the item's, which is then just as long.
    """
    out: list[tuple[int, int, int, bool, list[int]]] = []
    for mask, own in enumerate(seeds.masks):
        for first in range(-seeds.margin, 1):
            window = range(first, first + seeds.window)
            free = [p for p in window if p not in own]
            for gone in combinations(free, seeds.substitutions):
                out.append((mask, first, window.stop, False, [p for p in window if p not in gone]))
        for size in range(seeds.span, seeds.window):
            out += [(mask, first, first + size, True, list(range(first, first + size))) for first in range(seeds.span - size, 1)]
    rows = [(mask, k, *rest) for k, (mask, *rest) in enumerate(out)]
    return spark.createDataFrame(rows, "mask int, choice int, first int, end int, whole boolean, places array<int>")


def _chosen(rows: DataFrame, choices: DataFrame, prefix: str) -> DataFrame:
    """``rows`` (mask and the tokens around a hit), once for each choice that they have the tokens for, with its hash ``chosen``."""
    near, before = F.col(f"{prefix}_near"), F.col(f"{prefix}_before")
    fits = (before + F.col("first") >= 0) & (before + F.col("end") <= F.size(near))
    if prefix == "test":  # what is shorter than a window is a whole item
        fits &= F.col("whole") == (F.size(near) < F.col("least"))
        fits &= ~F.col("whole") | (F.size(near) == F.col("end") - F.col("first"))
    tokens = F.transform("places", lambda p: F.get(near, before + p))
    return rows.join(F.broadcast(choices), "mask").where(fits).select(*rows.columns, F.xxhash64("choice", tokens).alias("chosen"))


def contaminated(docs: DataFrame, tests: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """(doc_id, text_hash, n_hits, item_id) of the documents that overlap a test item.

    ``docs`` has doc_id and text, ``tests`` item_id and text.  ``n_hits`` counts the verified hits: places of the
    document and masks, whatever number of passages it overlaps there.  ``item_id`` is the
    smallest item with a hit.  Null and empty texts overlap with nothing, nor do items of fewer tokens than a
    mask spans, or documents of fewer than ``window`` but for whole short items: so little can be chance.
    ``text_hash`` is that of the text, null as empty; rows equal in doc_id and text are one document, whose
    hits count once.  Very long texts are searched whole.
    """
    items = tests.select("item_id", token_hashes(text_of()).alias("h"))
    passages = _windows(items, seeds).select("key", "mask", "item_id", *_around(seeds, "test"))
    passages = passages.groupBy("key", "mask", "test_near", "test_before").agg(F.min("item_id").alias("item_id"))
    keys = passages.groupBy("key").agg((F.count("*") > seeds.crowd).alias("crowded"))
    n, crowded = keys.agg(F.count("*"), F.coalesce(F.bool_or("crowded"), F.lit(False))).first()
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), token_hashes(text_of()).alias("h"))
    windows = _windows(rows, seeds)
    if n <= seeds.broadcast_rows:
        hits = windows.join(F.broadcast(keys), "key").select(*_DOC, "at", "mask", "key", "crowded", *_around(seeds, "doc"))
    else:
        places = windows.join(keys, "key").select(F.col("doc_id").alias("at_id"), F.col("text_hash").alias("at_hash"), "at", "mask", "key", "crowded").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash"))
        hits = places.join(rows, same).select(*_DOC, "at", "mask", "key", "crowded", *_around(seeds, "doc"))
    out = (*_DOC, "at", "mask", "item_id")
    same, verified = _verified(seeds)
    if not crowded:
        pairs = hits.join(passages.drop("mask"), "key").withColumn("same", same).where(verified).select(*out)
    else:
        hits, marked = stored(hits, "hits"), passages.join(keys, "key")
        few = hits.where("not crowded").join(marked.where("not crowded").drop("mask", "crowded"), "key").withColumn("same", same).where(verified)
        choices = _choices(docs.sparkSession, seeds).withColumn("least", F.lit(seeds.window))
        told = _chosen(marked.where("crowded"), choices, "test").groupBy("chosen").agg(F.min("item_id").alias("item_id"))
        many = _chosen(hits.where("crowded").drop("key"), choices, "doc").join(told, "chosen")
        pairs = few.select(*out).unionByName(many.select(*out))
    pairs = pairs.groupBy(*_DOC, "at", "mask").agg(F.min("item_id").alias("item_id"))
    return pairs.groupBy(*_DOC).agg(F.count("*").alias("n_hits"), F.min("item_id").alias("item_id"))


def flag(docs: DataFrame, tests: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """Each row of ``docs`` with n_hits (long), item_id, contaminated and kept (boolean); see contaminated.

    Columns of these names are replaced.
    """
    new = ("n_hits", "item_id", "contaminated", "kept")
    found = contaminated(docs, tests, seeds).select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("n_hits").alias("of_hits"), F.col("item_id").alias("of_item"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("th"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_hash")), "left")
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new]
    hit = F.col("of_hits").isNotNull()
    return both.select(*rest, F.coalesce("of_hits", F.lit(0)).cast("long").alias("n_hits"), F.col("of_item").alias("item_id"), hit.alias("contaminated"), (~hit).alias("kept"))
