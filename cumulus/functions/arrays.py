"""Array expressions over horizontal series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cumulus.functions._util import as_col


def day_value(counts, day_index: int) -> Column:
    """1-based day ``day_index`` of a series array; past the end gives null (ANSI-safe)."""
    return F.try_element_at(as_col(counts), F.lit(day_index))


def pairwise_growth(counts) -> Column:
    """First difference of a cumulative series array: element i minus element i-1.

    The first element is null, a null on either side gives null, an empty array
    stays empty and a null array stays null. Pure JVM expression, no UDF.
    """
    arr = as_col(counts)
    return F.transform(arr, lambda x, i: F.when(i > 0, x - F.get(arr, i - 1)))


def array_text(counts, sep: str = ",", null_text: str = "null") -> Column:
    """An array rendered as delimited text (for exports and for value comparison)."""
    return F.array_join(as_col(counts).cast("array<string>"), sep, null_text)
