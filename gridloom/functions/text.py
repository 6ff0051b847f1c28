"""String expressions with the white-space rules the data model asks for.

White space is Unicode's, with the four separators U+001C to U+001F, in every
strip and class; Spark's ``trim`` and Java's ``\\s`` know less of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character of white space, and what ends a line.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Any character that isn't white space: found at once in most texts.
NOT_BLANK = BLANK.replace("[", "[^", 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def bare(text: Column) -> Column:
    """``strip`` that leaves a text alone whose ends are plain ASCII."""
    plain = lambda c: F.ascii(c).between(33, 126)
    return F.when(plain(text) & plain(F.right(text, F.lit(1))), text).otherwise(strip(text))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def occurrences(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece)))) / len(piece)).cast("int")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def score(seed: Column, *parts: Column) -> Column:
    """A stable 64-bit score as 16 hex digits: their order is that of the numbers."""
    return F.substring(F.sha2(F.concat_ws(":", seed, *parts), 256), 1, 16)
