"""Scalar functions on text, dates and identifiers, all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose words aren't parted by blanks (kana without middle dot, ideographs).
CJK = r"\x{3040}-\x{30fa}\x{30fc}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
#: What may stand between the characters of a keyword.
GAP = r"[^\p{L}\p{N}_]*"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def fold_width(text: Column) -> Column:
    """Full-width ASCII and blanks in half width; null stays null."""
    return F.translate(text, _WIDE, _NARROW)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stored(text: Column) -> Column:
    """A sentence as the index keeps it."""
    return squeeze(fold_width(text))


def words(text: Column) -> Column:
    """Distinct lower-case words outside unspaced scripts; null for null."""
    rest = F.regexp_replace(F.lower(text), f"[{CJK}]+", " ")
    return F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _pairs(run: Column) -> Column:
    n = F.length(run)
    # sequence(1, 0) runs downwards, so single characters are told apart.
    return F.when(n < 2, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))
    )


def grams(text: Column) -> Column:
    """Distinct pairs of neighbours in runs of unspaced scripts; a lone character is itself a gram."""
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, _pairs)))


def readings(text: Column) -> Column:
    """Pairs of neighbours of a reading, as the reading index keeps them."""
    return F.array_distinct(_pairs(text))


def date_terms(seconds: Column) -> Column:
    """Year, month and day terms of an epoch; no terms for null and 0, which is unknown."""
    ts = F.timestamp_seconds(seconds)
    terms = F.array(F.date_format(ts, "yyyy"), F.date_format(ts, "yyyy/MM"), F.date_format(ts, "yyyy/MM/dd"))
    return F.when(seconds > 0, terms).otherwise(F.array().cast("array<string>"))


def hex_id(number: Column) -> Column:
    """Eight lower-case hex digits."""
    return F.lpad(F.lower(F.hex(number.cast("bigint"))), 8, "0")


def from_hex(text: Column) -> Column:
    """The number that hex digits spell; null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(text, 16, 10).cast("bigint"))


def key_hash(key: Column, seed: int = 5381) -> Column:
    """Hash of a key's bytes that a constant database buckets by; null for null."""
    codes = F.transform(F.split(F.hex(F.encode(key, "utf-8")), "(?<=\\G..)"), lambda h: F.conv(h, 16, 10).cast("bigint"))
    codes = F.filter(codes, lambda c: c.isNotNull())
    step = lambda h, c: (h * 33).bitwiseXOR(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(seed).cast("bigint"), step)


def marks(text: Column, pattern: str) -> Column:
    """Matches of a pattern set in ``<b>``."""
    return F.regexp_replace(text, pattern, "<b>$0</b>")
