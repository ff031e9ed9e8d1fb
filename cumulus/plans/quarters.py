"""Quarter totals of a cumulative measure.

A quarter's total is ``max - min`` of the day totals inside the quarter (so the
step from a quarter's last day to the next quarter's first day is not counted,
as in the reference). "percent" columns are fractions of the population.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.dates import quarter_index


def period_totals(log: DataFrame, keys: Sequence[str], measures: Sequence[str],
                  base_year: int = 2020, date_col: str = "observed_date") -> DataFrame:
    """Sum each measure per (keys, day), then ``max - min`` per (keys, quarter).

    Two aggregations, each partial on the map side; the second is keyed by a
    coarser key set than the first, so it shuffles a frame of one row per key
    and day only.
    """
    by_day = log.groupBy(*keys, date_col).agg(
        *[F.sum(m).cast("bigint").alias(f"{m}_by_date") for m in measures])
    quartered = by_day.withColumn("quarter", quarter_index(date_col, base_year))
    return quartered.groupBy(*keys, "quarter").agg(
        *[(F.max(f"{m}_by_date") - F.min(f"{m}_by_date")).alias(f"quarter_total_{m}") for m in measures])


def _scalar_population(places: DataFrame, uid) -> "F.Column":
    # One-row lookup as a scalar subquery: no driver round trip; no such uid gives
    # null, and a repeated uid takes one row (as the reference's ``first``) instead
    # of failing the subquery.
    return places.where(F.col("uid") == F.lit(uid)).agg(F.first("population")).scalar()


def us_percent_by_quarter(log: DataFrame, places: DataFrame, country: str = "US", uid: int = 840,
                          base_year: int = 2020) -> DataFrame:
    """Query 7: quarter totals of confirmed for one country, as a fraction of its population."""
    totals = period_totals(log.where(F.col("country") == country), [], ["confirmed"], base_year)
    pop = _scalar_population(places, uid)
    return totals.select(
        "quarter", "quarter_total_confirmed",
        F.try_divide(F.col("quarter_total_confirmed"), pop).cast("double").alias("quarter_total_confirmed_percent"),
    )


def us_all_percent_by_quarter(log: DataFrame, places: DataFrame, country: str = "US", uid: int = 840,
                              base_year: int = 2020) -> DataFrame:
    """Query 8: as Query 7 for confirmed, deaths and recovered."""
    measures = ("confirmed", "deaths", "recovered")
    totals = period_totals(log.where(F.col("country") == country), [], measures, base_year)
    pop = _scalar_population(places, uid)
    return totals.select(
        "quarter",
        *[f"quarter_total_{m}" for m in measures],
        *[F.try_divide(F.col(f"quarter_total_{m}"), pop).cast("double").alias(f"quarter_total_{m}_percent")
          for m in measures],
    )


def global_percent_by_quarter(log: DataFrame, places: DataFrame, base_year: int = 2020) -> DataFrame:
    """Query 9: per country and quarter, total confirmed and its fraction of the population.

    Inner join with the country-level rows of the place dimension (countries
    missing there drop out; see :func:`unmatched_countries`). Both join sides are
    one row per country (times quarters on the left); Spark/AQE pick broadcast by
    measured size.
    """
    totals = period_totals(log, ["country"], ["confirmed"], base_year)
    pop = places.where(F.col("region").isNull()).select("country", "population")
    return totals.join(pop, "country").select(
        "country", "quarter", "quarter_total_confirmed",
        F.try_divide(F.col("quarter_total_confirmed"), F.col("population")).cast("double")
        .alias("quarter_total_confirmed_percent"),
    )


def unmatched_countries(log: DataFrame, places: DataFrame) -> DataFrame:
    """Countries of the log that have no country-level row in the place dimension."""
    pop = places.where(F.col("region").isNull()).select("country")
    return log.select("country").distinct().join(pop, "country", "left_anti")
