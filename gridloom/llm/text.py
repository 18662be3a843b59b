"""Text rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def spaced(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{SPACE}]+", " ")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
