"""Canonical ids and tolerant numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any kind, with the invisible joiners that
# exports leave behind.
BLANKS = r"[\s\p{Z}\u0085​‌‍⁠﻿]"


def strip_blanks(c: Column) -> Column:
    """``c`` without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def canonical_id(c: Column) -> Column:
    """Trimmed id text; ``12345.0`` reads ``12345``; null gives the empty text."""
    text = strip_blanks(c.cast("string"))
    return F.coalesce(F.regexp_replace(text, r"^([+-]?\d+)\.0+$", "$1"), F.lit(""))


def integer_id(c: Column) -> Column:
    """The id as bigint, read from its digits (never through a double).

    White space at the ends and a decimal part of zeros only are removed.
    Null, blank and unreadable ids give null.
    """
    text = F.regexp_replace(strip_blanks(c.cast("string")), r"\.0*$", "")
    return text.try_cast("bigint")


def safe_double(c: Column) -> Column:
    """Number or null: text that is no number, NaN and infinities give null."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def missing_nan(c: Column) -> Column:
    """``c`` as double with NaN as null; infinities stay."""
    number = c.cast("double")
    return F.when(~F.isnan(number), number)
