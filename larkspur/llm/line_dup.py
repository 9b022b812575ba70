"""Line deduplication: keep bitmaps of the lines that repeat across documents.

Only hashes travel.  Each line becomes (hash, document, position); these are range-partitioned by
hash and document and sorted within the partitions by hash, document and position, so one pass over
sorted rows streams the first occurrence of a line in each document.  A line that a third of all rows
hold spreads over many ranges, as the document is part of the range; its documents are counted by
partial sums.  The common lines are written as a table of their own: Spark broadcasts it to the lines if its
files are small, and else can split a hot line's rows in the join.  What comes back to the texts is one run-length-compressed keep bitmap a document.

Lines are compared by 96 bits of hash of their keys.  A document is a row's (doc_id, text): rows
that repeat both count as one document, and each of them gets the bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._sql import SPACES, lower_ascii, text_of
from ._store import stored

_DOC = ("doc_id", "text_hash")
_OPEN = 2**31 - 1


def line_hashes(docs: DataFrame, *, least_chars: int = 1) -> DataFrame:
    """(a, b, doc_id, text_hash, pos) of each line whose key has ``least_chars`` code points or more."""
    keys = F.transform(F.split(lower_ascii(text_of()), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= least_chars, F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))))
    lines = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), F.posexplode(hashed).alias("pos", "line"))
    return lines.where("line is not null").select("line.a", "line.b", *_DOC, "pos")


def bitmaps(docs: DataFrame, *, min_docs: int = 10, keep_first: bool = False, least_chars: int = 1) -> DataFrame:
    """(doc_id, text_hash, kept) of the documents that lose a line.

    Lines whose key is in ``min_docs`` documents or more go: all of them, or all but the first by
    doc_id and position with ``keep_first``.  ``kept`` has the runs of kept lines, as their first
    position and their number; the last run goes on to the end.  Very long texts are split whole.
    """
    order = ["a", "b", *_DOC, "pos"]
    every = stored(line_hashes(docs, least_chars=least_chars), "lines")
    lines = every.repartitionByRange("a", *_DOC).sortWithinPartitions(*order)
    in_doc = Window.partitionBy("a", "b", *_DOC).orderBy("pos")
    lines = lines.withColumn("opens", (F.row_number().over(in_doc) == 1).cast("int"))
    counts = [F.sum("opens").alias("docs")] + ([F.min(F.struct(*_DOC, "pos")).alias("first")] if keep_first else [])
    common = stored(lines.groupBy("a", "b").agg(*counts).where(F.col("docs") >= min_docs).drop("docs"), "common")
    lost = every.join(common, ["a", "b"])
    if keep_first:
        lost = lost.where(~F.struct(*_DOC, "pos").eqNullSafe(F.col("first")))
    places = lost.groupBy(*_DOC).agg(F.sort_array(F.collect_set("pos")).alias("p"))
    return places.select(*_DOC, "p").withColumn("kept", _kept_runs("p")).drop("p")


def _kept_runs(p: str) -> Column:
    """The runs (at, size) between sorted distinct lost positions; the last one is open."""
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(F.col(p), i - 1) != x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(F.col(p), i + 1) != x + 1))
    after = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    return F.zip_with(after, starts, lambda at, to: F.struct(at.alias("at"), (F.coalesce(to, F.lit(_OPEN)) - at).alias("size")))


def drop_lines(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``maps`` keeps, and n_lines, n_dropped (long).

    A null text counts as an empty one: one empty line.  Columns of these names are replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_of().alias("t"), F.xxhash64(text_of()).alias("th"))
    maps = maps.select(F.col("doc_id").alias("map_id"), F.col("text_hash").alias("map_hash"), "kept")
    both = rows.join(maps, F.col("id").eqNullSafe(F.col("map_id")) & (F.col("th") == F.col("map_hash")), "left")
    both = both.withColumn("lines", F.split("t", "\n"))
    left = F.flatten(F.transform("kept", lambda r: F.slice("lines", r["at"] + 1, r["size"])))
    both = both.withColumn("left", F.when(F.col("kept").isNull(), F.col("lines")).otherwise(left))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.array_join("left", "\n")
    return both.select(
        *((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in rest),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
    )
