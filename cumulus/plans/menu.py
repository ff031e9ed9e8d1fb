"""The nine menu queries over a folder of raw input files (the reference's console
menu, re-aimed as a function: no interactive loop, the caller shows or writes
the result).

    frames = load_all(spark, folder)
    menu_query(4, frames, start_date).show()
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from cumulus.operators.merge import merge_global, merge_global_vertical
from cumulus.operators.shapes import to_vertical_many
from cumulus.plans import quarters, rates, trends
from cumulus.schemas import GLOBAL_IDS
from cumulus.sources.catalog import INPUT_FILES
from cumulus.sources.csv import read_wide_csv, read_wide_releases

MENU = {
    1: "Global confirmed cases (unpacked)",
    2: "Global confirmed cases (vertical)",
    3: "Global confirmed cases daily growth (unpacked)",
    4: "Global confirmed cases each country (incidence)",
    5: "Global cases tropical and non-tropical countries",
    6: "Global death rates",
    7: "US confirmed cases per capita by quarter",
    8: "US confirmed cases, deaths and recovered per capita by quarter",
    9: "Global confirmed cases per capita by quarter",
}


def series_start(spark: SparkSession, folder: str, releases: bool = False) -> _dt.date:
    """First day of the global series in ``folder`` (read from its header line, or those of its ``releases``)."""
    path = f"{folder.rstrip('/')}/{INPUT_FILES['global_confirmed']}"
    return (read_wide_releases(spark, path) if releases else read_wide_csv(spark, path)).start_date


def menu_query(number: int, frames: dict[str, DataFrame], start_date: _dt.date, **options) -> DataFrame:
    """Menu option ``number`` (1-9) over the frames of ``sources.load_all``.

    ``options`` go to the underlying query (``n_days``, ``label_format``, ``keep``, ``id_order``,
    ``day_index``, ``countries``, ``country``, ``uid``, ``base_year``, ...); one it does not know raises.
    """
    c, d, r = frames["global_confirmed"], frames["global_deaths"], frames["global_recovered"]
    places, log = frames["places"], frames["observation_log"]
    if number in (1, 3):
        merged = merge_global(c, d, r)
        fn = trends.global_count_unpacked if number == 1 else trends.growth_unpacked
        return fn(merged, "confirmed", start_date, **options)
    if number == 2:
        v = to_vertical_many({"c": c, "d": d, "r": r}, GLOBAL_IDS, start_date, id_order=options.pop("id_order", None))
        return trends.global_count_vertical(merge_global_vertical(*v.values()), **options)
    if number == 4:
        return rates.incidence(c, places, **options)
    if number == 5:
        return rates.tropical_vs_non_tropical(c, places, **options)
    if number == 6:
        return rates.death_rates(d, c, **options)
    if number == 7:
        return quarters.us_percent_by_quarter(log, places, **options)
    if number == 8:
        return quarters.us_all_percent_by_quarter(log, places, **options)
    if number == 9:
        return quarters.global_percent_by_quarter(log, places, **options)
    raise ValueError(f"menu option must be 1-9, not {number}")
