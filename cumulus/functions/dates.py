"""Date parsing and date-derived keys."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cumulus.functions._util import as_col

# The five layouts of the "last updated" field in observation logs,
# e.g. "1/22/2020 17:00", "1/22/20 17:00", "1/22/20 7:00", "2020-02-01T19:53:03",
# "2020-03-08 05:31:00". One- and two-digit hours share the "H" pattern, so
# "1/22/20 0:30" parses too. Each layout is paired with a regex for the shape of
# its date part, so a value is parsed with one layout only.
UPDATE_DATE_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4} ", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{2} ", "M/d/yy H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} ", "yyyy-MM-dd HH:mm:ss"),
)

# Fixed value: layout of the observation date column, e.g. "01/22/2020".
OBSERVED_DATE_FORMAT = "MM/dd/yyyy"

# Fixed value: label of an unpacked day column, e.g. "Jan 22 '20".
_DAY_LABEL_PY = "%b %d '%y"


def _two_digit_year(fmt: str) -> bool:
    return "yy" in fmt and "yyy" not in fmt


def update_date(c, formats=UPDATE_DATE_FORMATS, pivot: int | None = None) -> Column:
    """Text in any of the known layouts to a date (time of day dropped); anything else gives null.

    The date part's shape picks the one layout to try (a regex test is much
    cheaper than a failed parse); text of that shape that still does not parse
    gives null. Two-digit years are 2000-2099 (reference rule); with ``pivot`` those
    at or above it are 19xx.
    """
    c = as_col(c)
    expr = None
    for shape, fmt in formats:
        d = F.try_to_timestamp(c, F.lit(fmt)).cast("date")
        if pivot is not None and _two_digit_year(fmt):
            d = F.when(F.year(d) >= 2000 + pivot, F.add_months(d, -1200)).otherwise(d)
        cond = c.rlike(shape)
        expr = F.when(cond, d) if expr is None else expr.when(cond, d)
    return expr


def observed_date(c, fmt: str = OBSERVED_DATE_FORMAT) -> Column:
    """Strict fixed-layout date; text that does not fit gives null."""
    return F.try_to_timestamp(as_col(c), F.lit(fmt)).cast("date")


def quarter_index(c, base_year: int = 2020) -> Column:
    """Running quarter number: 1-4 for the quarters of ``base_year``, 5 for the next Q1, ..."""
    c = as_col(c)
    return (F.quarter(c) + F.lit(4) * (F.year(c) - F.lit(base_year))).cast("int")


def day_label(start: _dt.date, offset: int, fmt: str = _DAY_LABEL_PY) -> str:
    """Driver-side column name of day ``offset`` counted from ``start`` ("Jan 22 '20")."""
    return (start + _dt.timedelta(days=offset)).strftime(fmt)


def parse_header_day(name: str, pivot: int | None = None) -> _dt.date | None:
    """A wide-file header label such as "1/22/20" to a date; None if it is not a day column.

    Two-digit years are 2000-2099; with ``pivot`` those at or above it are 19xx."""
    parts = name.strip().split("/")
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        return None
    month, day, year = (int(p) for p in parts)
    if len(parts[2]) <= 2:
        year += 1900 if pivot is not None and year >= pivot else 2000
    try:
        return _dt.date(year, month, day)
    except ValueError:
        return None


def header_day_name(d: _dt.date) -> str:
    """Inverse of :func:`parse_header_day` ("1/22/20")."""
    return f"{d.month}/{d.day}/{d.year % 100:02d}"
