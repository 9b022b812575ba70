"""Words of a text as DataFrame expressions.  White space is ``[\\x20\\x09-\\x0D]`` throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def paired(hashes: str, apart: int) -> Column:
    """Hash of each element with the one ``apart`` places later; the last ``apart`` elements have none."""
    h, n = F.col(hashes), F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, apart + 1, n), lambda a, b: F.xxhash64(a, b))
