"""Series views of the merged global data."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.operators.growth import growth_horizontal
from cumulus.operators.shapes import series_width, to_unpacked


def global_count_unpacked(merged: DataFrame, which: str, start_date: _dt.date,
                          n_days: int | None = None, label_format: str | None = None) -> DataFrame:
    """Query 1: country-level rows, one column per day of measure ``which``.

    Day columns are named "Jan 22 '20", or by the ``strftime`` pattern
    ``label_format``. The width is ``n_days`` or, if not given, learned with one
    small aggregate (see :func:`series_width`). The filter is on a key of the merge, so
    Spark moves it below the merge to every input.
    """
    countries = merged.where(F.col("region").isNull())
    if n_days is None:
        n_days = series_width(countries, which)
    namer = (lambda d: d.strftime(label_format)) if label_format else None
    return to_unpacked(countries, ["country", "latitude", "longitude"], which, start_date, n_days, namer=namer)


def growth_unpacked(merged: DataFrame, which: str, start_date: _dt.date, n_days: int | None = None,
                    label_format: str | None = None) -> DataFrame:
    """Query 3: daily growth of ``which``, unpacked (first day null)."""
    return global_count_unpacked(growth_horizontal(merged, which), f"{which}_growth", start_date, n_days,
                                 label_format)


def global_count_vertical(merged_vertical: DataFrame, keep: tuple[str, ...] | None = ("confirmed",)) -> DataFrame:
    """Query 2: country-level rows of the vertical merge, region dropped.

    ``keep`` lists the measures to keep (Query 2 keeps confirmed only); None keeps all.
    """
    out = merged_vertical.where(F.col("region").isNull()).drop("region")
    if keep is not None:
        out = out.drop(*[m for m in ("confirmed", "deaths", "recovered") if m not in keep])
    return out


def us_count_vertical(us_merged_vertical: DataFrame) -> DataFrame:
    """The vertical US merge without ``country``."""
    return us_merged_vertical.drop("country")
