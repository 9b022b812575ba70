"""A corpus pipeline over the documents table: each stage works on all that the one before it kept.

Quality rules and line deduplication come first, as they are cheap and shrink what follows; near
duplicates are found in texts without common lines, and benchmark overlaps in one text of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._store import stored
from larkspur.llm.decontaminate import flag
from larkspur.llm.line_dup import bitmaps, drop_lines
from larkspur.llm.near_dup import near_duplicates
from larkspur.llm.quality_rules import apply_rules
from larkspur.llm.sentence_pieces import encode, read_model


def _wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs``, and each row whole as ``row``: what a stage adds can't clash with what docs has."""
    return docs.select(*(c for c in columns if c in docs.columns), F.struct("*").alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, with the columns of ``docs`` unchanged.

    Null and empty texts have too few words and go.  Each row is judged by itself, so repeated rows go or stay
    together and null ids don't matter.  The rules are those of the module; measuring them here as well, for each
    run anew, takes memory that executors lack (see README).  The verdicts are written before they are used.
    """
    judged = stored(apply_rules(_wrapped(docs, "text", "lang")).select("row", "kept"), "judged")
    return judged.where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that ten documents or more share; n_chars follows the text.

    Rows equal in doc_id and text count as one document.  A text without such lines is unchanged; a null one
    becomes empty.  A text of common lines only becomes empty and stays.  Other columns are unchanged.
    """
    wrapped = _wrapped(docs, "doc_id", "text")
    out = drop_lines(wrapped, bitmaps(wrapped))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose doc_id is the smallest of its group of near duplicates, with all columns of ``docs``.

    Rows without a doc_id or without words take no part and stay.  Rows that repeat a doc_id stay or go together.
    """
    others = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that overlap no benchmark item, with the columns of ``docs`` unchanged.

    Null and empty texts overlap with nothing and stay, as all rows do if the benchmark is empty.
    """
    found = flag(_wrapped(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("kept").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded and parity of each row; see sentence_pieces.encode.

    Null and empty texts have no ids.  Other columns of ``docs`` are left out.
    """
    return encode(docs, read_model(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encode_decode", encoding),
]

# Near duplicates and SentencePiece ids are beyond SQL: tests/llm holds each stage against its own brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, each stage's result but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
