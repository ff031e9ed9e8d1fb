"""Rates between a measure and population or between two measures (M5, M6, M7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.arrays import day_value

# The reference's final day index and its six countries.
DEFAULT_DAY_INDEX = 466
DEFAULT_COUNTRIES = ("US", "India", "Germany", "Japan", "Brazil", "Nigeria")
TROPIC_LATITUDE = 23.5


def incidence(confirmed: DataFrame, places: DataFrame, day_index: int = DEFAULT_DAY_INDEX,
              include_counts: bool = False) -> DataFrame:
    """Query 4: per series row, value on day ``day_index`` divided by its country's population.

    Joins on country with the country-level rows of the place dimension (so a
    province row is divided by its whole country's population, as in the
    reference). Past the end of the array or with null/zero population the
    incidence is null. Sorted by incidence, descending, nulls last.
    """
    pop = places.where(F.col("region").isNull()).select("country", "population")
    value = day_value("counts", day_index)
    cols = [F.col("country"), F.try_divide(value, F.col("population")).cast("double").alias("incidence")]
    if include_counts:
        cols += [value.alias("confirmed"), F.col("population")]
    return confirmed.join(pop, "country").select(*cols).orderBy(F.col("incidence").desc_nulls_last())


def tropical_vs_non_tropical(confirmed: DataFrame, places: DataFrame, day_index: int = DEFAULT_DAY_INDEX,
                             on: str = "latitude") -> DataFrame:
    """Query 5: totals of confirmed (day ``day_index``) and population for tropical
    (|latitude| < 23.5) and non-tropical (|latitude| > 23.5) places; always two rows.

    The reference joins series and places on ``on`` (latitude by default), so
    every series row pairs with every place row of equal latitude, and sums over
    those pairs. The pairs are never built here: both sides are first reduced to
    one row per key value (sum of values, row count), and the pair sums are
    sum(values) x count(other side) per key. A key shared by many rows (every
    place with unknown coordinates has latitude 0) therefore costs one row, not
    the product of its counts. Totals are bigint: as with a plain SUM over the
    pairs under ANSI mode, a total past 2**63 raises rather than wrapping.
    """
    s = confirmed.groupBy(on).agg(
        F.sum(day_value("counts", day_index)).alias("s_sum"),
        F.count(F.lit(1)).alias("s_n"),
    )
    lat = F.abs(F.col("latitude"))
    climate = F.when(lat < TROPIC_LATITUDE, F.lit("tropical")).when(lat > TROPIC_LATITUDE, F.lit("non-tropical"))
    p = places.select(on, climate.alias("climate"), "population").where(F.col("climate").isNotNull()) \
        .groupBy(on, "climate").agg(F.sum("population").alias("p_sum"), F.count(F.lit(1)).alias("p_n"))
    per_class = s.join(p, on).select(
        "climate",
        (F.col("s_sum") * F.col("p_n")).alias("conf"),
        (F.col("p_sum") * F.col("s_n")).alias("pop"),
    ).groupBy("climate").agg(F.sum("conf").alias("sum_confirmed"), F.sum("pop").alias("sum_population"))
    # Two-row spine keeps a class whose join is empty (sums null, as a global
    # aggregate over no rows gives). per_class has at most two rows.
    spine = per_class.sparkSession.range(1).select(
        F.explode(F.array(F.lit("tropical"), F.lit("non-tropical"))).alias("climate"))
    return spine.join(F.broadcast(per_class), "climate", "left").select(
        "climate",
        F.col("sum_confirmed").cast("bigint").alias("sum_confirmed"),
        F.col("sum_population").cast("bigint").alias("sum_population"),
        F.try_divide(F.col("sum_confirmed"), F.col("sum_population")).cast("double").alias("incidence"),
    )


def death_rates(deaths: DataFrame, confirmed: DataFrame, countries: Sequence[str] = DEFAULT_COUNTRIES,
                keys: Sequence[str] = ("region", "country"), with_date: bool = False,
                start_date=None) -> DataFrame:
    """Query 6: per place of the listed countries and per day: deaths, cases and deaths / cases.

    The two series are joined on the whole place key (null-safe on region), so
    each place's deaths meet its own cases. (The reference joined on country
    only, which is the same for its six single-row countries but pairs every
    province with every other province elsewhere.) ``arrays_zip`` pads the
    shorter array with nulls; ``posexplode`` keeps the day so ``with_date`` can
    add it. ``keys`` must identify one row per place in each frame (e.g. ``uid``
    for US files); a coarser key would pair places with each other.
    """
    d = deaths.where(F.col("country").isin(*countries)).alias("d")
    c = confirmed.where(F.col("country").isin(*countries)).alias("c")
    cond = None
    for k in keys:
        e = F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
        cond = e if cond is None else cond & e
    pairs = d.join(c, cond).select(
        F.col("d.country").alias("country"),
        F.posexplode(F.arrays_zip(F.col("d.counts").alias("deaths"), F.col("c.counts").alias("cases")))
        .alias("day", "v"),
    )
    cols = [F.col("country"), F.col("v.deaths").alias("deaths"), F.col("v.cases").alias("cases"),
            F.try_divide(F.col("v.deaths"), F.col("v.cases")).cast("double").alias("death_rate")]
    if with_date:
        cols.insert(1, F.date_add(F.lit(start_date).cast("date"), F.col("day")).alias("date"))
    # Ordered by country then day after the explode (the reference sorted before
    # exploding, which leaves the final order undefined).
    return pairs.orderBy("country", "day").select(*cols)
