"""Null-safe number parsing for text columns (cleaning rules C1 and C4-C7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cumulus.functions._util import as_col


def try_long(c) -> Column:
    """Integer text to bigint; null, empty or non-integer text gives null (never raises)."""
    return as_col(c).try_cast("bigint")


_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def float_text_long(c) -> Column:
    """Integer or float text ("1001.0") to bigint, truncating; bad text gives null.

    Integer-shaped text is cast exactly; anything else goes through double. (A
    regex test first: a failed cast costs an exception per row inside the JVM.)
    """
    c = as_col(c)
    return F.when(c.rlike(_INTEGER_TEXT), c.try_cast("bigint")).otherwise(c.try_cast("double").try_cast("bigint"))


def measure_long(c) -> Column:
    """A measure written as "N" or "N.0" to bigint.

    The reference cut the last two characters, so "123" became 1 and null failed;
    here both spellings give N and null stays null.
    """
    return float_text_long(c)


def coordinate(c) -> Column:
    """Latitude/longitude text to float; null becomes 0.0 (reference rule), text that
    is no number becomes null (see the bad-row frames of ``operators.cleaning``)."""
    c = as_col(c)
    return F.when(c.isNull(), F.lit(0.0).cast("float")).otherwise(c.try_cast("float"))


def code_or_zero(c, dtype: str = "bigint") -> Column:
    """A numeric code (code3, FIPS) that may be written as float text; null becomes 0
    (reference rule), text that is no number of ``dtype`` becomes null."""
    c = as_col(c)
    return F.when(c.isNull(), F.lit(0).cast(dtype)).otherwise(float_text_long(c).try_cast(dtype))
