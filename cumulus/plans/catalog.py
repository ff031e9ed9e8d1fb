"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the
whole Parquet tables of ``sf_dir`` (via the derived inputs of ``fixtures``, which
are written once per session; the raw-text queries also write their input text
first, and row ordinals write their tagged rows once).

Array columns are returned as delimited text (``array_text``) so that results
can be compared value by value with a SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.functions.arrays import array_text
from cumulus.functions.dates import update_date
from cumulus.functions.parse import try_long
from cumulus.functions.text import normalise_country, normalise_region
from cumulus.operators import cleaning
from cumulus.operators.file_order import file_ordinal
from cumulus.operators.growth import growth_horizontal, growth_vertical, growth_vertical_spread
from cumulus.operators.merge import merge_global, merge_global_vertical, merge_us, merge_us_vertical
from cumulus.operators.shapes import dense_ordinal, to_horizontal, to_vertical
from cumulus.plans import fixtures as fx
from cumulus.plans import quarters, rates, rendering, trends
from cumulus.plans.menu import menu_query
from cumulus.schemas import GLOBAL_IDS, US_IDS
from cumulus.session import release, scratch_path
from cumulus.sinks.csv import preview_rows, write_csv, write_wide_csv
from cumulus.sources.catalog import load_all, register_views
from cumulus.sources.csv import read_lines, read_table_csv, read_wide_csv, read_wide_releases, tokenised_lines

Query = Callable[[SparkSession, str], DataFrame]

_PLACE_ORDER = ["country", "region"]


def _calendar(spark: SparkSession, sf_dir: str):
    """First day and length of the derived calendar (the driver names day columns);
    one small aggregate the first time per session and folder."""
    return rendering.calendar_values(spark, sf_dir)


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[array_text(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _merged(spark, sf_dir) -> DataFrame:
    gs = fx.global_series(spark, sf_dir)
    return merge_global(gs["confirmed"], gs["deaths"], gs["recovered"])


def reset(spark: SparkSession | None = None) -> None:
    """Forget every prepared input, so the next query derives it from the tables anew; with a
    session, also delete what this one has written to scratch (ACTION)."""
    fx.reset()
    rendering.reset()
    if spark is not None:
        release(spark)


def prepare_all(spark: SparkSession, sf_dir: str) -> None:
    """ACTION: write the prepared inputs once: the fixture tables, with the numbered
    series stored by place, and the raw observation-log text the CSV load queries read.
    The queries that follow then do only their own work. (The other raw files
    are rendered on first use, also once per session.)"""
    fx.prepare(spark, sf_dir)
    rendering.render_log(spark, sf_dir)


def _merged_vertical(spark, sf_dir) -> DataFrame:
    v = fx.global_series_vertical(spark, sf_dir)
    return merge_global_vertical(v["confirmed"], v["deaths"], v["recovered"])


def _us_vertical(spark, sf_dir) -> dict[str, DataFrame]:
    us = fx.us_series(spark, sf_dir)
    cal = fx.calendar(spark, sf_dir)
    return {
        "confirmed": to_vertical(us["confirmed"], US_IDS, cal.start, id_col=None),
        "deaths": to_vertical(us["deaths"], [*US_IDS, "population"], cal.start, id_col=None),
    }


# ---- M8-M10 -----------------------------------------------------------------

def q_global_percent_by_quarter(spark, sf_dir):
    return quarters.global_percent_by_quarter(
        fx.observation_log(spark, sf_dir), fx.places(spark, sf_dir), base_year=fx.LOG_BASE_YEAR)


def q_us_percent_by_quarter(spark, sf_dir):
    return quarters.us_percent_by_quarter(
        fx.observation_log(spark, sf_dir), fx.places(spark, sf_dir),
        country=fx.FOCUS_COUNTRY, uid=fx.FOCUS_UID, base_year=fx.LOG_BASE_YEAR)


def q_us_all_percent_by_quarter(spark, sf_dir):
    return quarters.us_all_percent_by_quarter(
        fx.observation_log(spark, sf_dir), fx.places(spark, sf_dir),
        country=fx.FOCUS_COUNTRY, uid=fx.FOCUS_UID, base_year=fx.LOG_BASE_YEAR)


# ---- M5-M7 ------------------------------------------------------------------

def q_incidence(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    return rates.incidence(gs["confirmed"], fx.places(spark, sf_dir), day_index=fx.DAY_INDEX)


def q_incidence_with_counts(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    return rates.incidence(gs["confirmed"], fx.places(spark, sf_dir), day_index=fx.DAY_INDEX, include_counts=True)


def q_tropical_vs_non_tropical_by_country(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    return rates.tropical_vs_non_tropical(gs["confirmed"], fx.places(spark, sf_dir), day_index=fx.DAY_INDEX,
                                          on="country")


def q_tropical_vs_non_tropical(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    return rates.tropical_vs_non_tropical(gs["confirmed"], fx.places(spark, sf_dir), day_index=fx.DAY_INDEX)


def q_death_rates(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    cal = fx.calendar(spark, sf_dir)
    return rates.death_rates(gs["deaths"], gs["confirmed"], fx.DEATH_RATE_COUNTRIES,
                             with_date=True, start_date=cal.start)


# ---- merges, shapes, growth ---------------------------------------------------

def q_merge_global(spark, sf_dir):
    return _text(_merged(spark, sf_dir), "confirmed", "deaths", "recovered")


def q_merge_us(spark, sf_dir):
    us = fx.us_series(spark, sf_dir)
    return _text(merge_us(us["confirmed"], us["deaths"]), "confirmed", "deaths")


def q_merge_global_vertical(spark, sf_dir):
    return _merged_vertical(spark, sf_dir)


def q_merge_us_vertical(spark, sf_dir):
    v = _us_vertical(spark, sf_dir)
    return merge_us_vertical(v["confirmed"], v["deaths"])


def q_global_count_unpacked(spark, sf_dir):
    start, n_days = _calendar(spark, sf_dir)
    return trends.global_count_unpacked(_merged(spark, sf_dir), "confirmed", start, n_days)


def q_growth_unpacked(spark, sf_dir):
    start, n_days = _calendar(spark, sf_dir)
    return trends.growth_unpacked(_merged(spark, sf_dir), "confirmed", start, n_days)


def q_global_count_vertical(spark, sf_dir):
    return trends.global_count_vertical(_merged_vertical(spark, sf_dir))


def q_us_count_vertical(spark, sf_dir):
    v = _us_vertical(spark, sf_dir)
    return trends.us_count_vertical(merge_us_vertical(v["confirmed"], v["deaths"]))


def q_growth_horizontal(spark, sf_dir):
    g = growth_horizontal(_merged(spark, sf_dir), "confirmed")
    return _text(g.select("region", "country", "confirmed_growth"), "confirmed_growth")


def q_growth_vertical(spark, sf_dir):
    return growth_vertical(_merged_vertical(spark, sf_dir), "confirmed", ["region", "country"])


def q_growth_vertical_us(spark, sf_dir):
    v = _us_vertical(spark, sf_dir)
    return growth_vertical(merge_us_vertical(v["confirmed"], v["deaths"]), "deaths", "uid")


def q_to_horizontal_global(spark, sf_dir):
    v = fx.series_vertical(spark, sf_dir)
    cal = fx.calendar(spark, sf_dir)
    return _text(to_horizontal(v, GLOBAL_IDS, "deaths", cal.start, cal.n_days), "counts")


def q_to_horizontal_us(spark, sf_dir):
    return _text(fx.us_series(spark, sf_dir)["deaths"], "counts")


def q_to_vertical_global(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    cal = fx.calendar(spark, sf_dir)
    return to_vertical(gs["recovered"], GLOBAL_IDS, cal.start, id_order=_PLACE_ORDER)


def q_to_vertical_us(spark, sf_dir):
    return _us_vertical(spark, sf_dir)["deaths"]


def q_dense_ordinal(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return dense_ordinal(orders, "id", order_by=["o_orderdate", "o_orderkey"])


# ---- raw text in, cleaning, CSV out ---------------------------------------------
# These write the derived inputs as raw text first (an action), then return a
# lazy read of it.

def q_load_wide_csv(spark, sf_dir):
    wide = read_wide_csv(spark, rendering.render_global(spark, sf_dir, "confirmed"))
    return _text(cleaning.global_horizontal(wide), "counts")


def q_parse_quoted_lines(spark, sf_dir):
    toks = tokenised_lines(read_lines(spark, rendering.render_quoted(spark, sf_dir)))
    t = F.col("tokens")
    total = F.aggregate(F.slice(t, 5, F.size(t) - 4), F.lit(0).cast("bigint"),
                        lambda acc, x: acc + F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))
    return toks.select(F.size(t).alias("n_fields"), F.get(t, 0).alias("region"), F.get(t, 1).alias("country"),
                       total.alias("total"))


def q_load_wide_csv_vertical(spark, sf_dir):
    wide = read_wide_csv(spark, rendering.render_global(spark, sf_dir, "deaths"))
    return cleaning.global_vertical(wide, id_order=_PLACE_ORDER)


def q_load_us_csv_vertical(spark, sf_dir):
    wide = read_wide_csv(spark, rendering.render_us_deaths(spark, sf_dir))
    return cleaning.us_vertical(wide, with_population=True)


def q_load_us_csv(spark, sf_dir):
    wide = read_wide_csv(spark, rendering.render_us_deaths(spark, sf_dir))
    return _text(cleaning.us_horizontal(wide, with_population=True), "counts")


def q_clean_place_dim(spark, sf_dir):
    return cleaning.place_dim(read_table_csv(spark, rendering.render_places(spark, sf_dir)))


def _raw_log(spark, sf_dir):
    return read_table_csv(spark, rendering.render_log(spark, sf_dir))


def q_clean_observation_log(spark, sf_dir):
    return cleaning.observation_log(_raw_log(spark, sf_dir), pivot=fx.TWO_DIGIT_YEAR_PIVOT)


def q_parse_update_dates(spark, sf_dir):
    raw = _raw_log(spark, sf_dir)
    c = raw.columns
    return raw.select(try_long(F.col(c[0])).alias("id"), F.col(f"`{c[4]}`").alias("last_update_text"),
                      update_date(F.col(f"`{c[4]}`"), pivot=fx.TWO_DIGIT_YEAR_PIVOT).alias("last_updated"))


def q_normalise_region(spark, sf_dir):
    raw = _raw_log(spark, sf_dir)
    c = [F.col(f"`{n}`") for n in raw.columns]
    return raw.select(try_long(c[0]).alias("id"), c[2].alias("region_raw"),
                      normalise_region(c[2], c[3]).alias("region"))


def q_normalise_country(spark, sf_dir):
    raw = _raw_log(spark, sf_dir)
    c = [F.col(f"`{n}`") for n in raw.columns]
    return raw.select(try_long(c[0]).alias("id"), c[3].alias("country_raw"),
                      normalise_country(c[3]).alias("country"))


def q_csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "query2-csv")
    write_csv(trends.global_count_vertical(_merged_vertical(spark, sf_dir)), path, include_header=True)
    return rendering.read_back_vertical(spark, path)


# ---- the raw files end to end, and the variants a user can ask for -----------------

def q_global_count_unpacked_learned(spark, sf_dir):
    start, _ = _calendar(spark, sf_dir)
    return trends.global_count_unpacked(_merged(spark, sf_dir), "deaths", start)


def q_to_horizontal_sparse(spark, sf_dir):
    daily = fx.daily_events(spark, sf_dir).where("confirmed > 0")
    cal = fx.calendar(spark, sf_dir)
    return _text(to_horizontal(daily, ["region", "country"], "confirmed", cal.start, cal.n_days), "counts")


def q_ordinal_file_order(spark, sf_dir):
    return file_ordinal(fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "id")


def q_load_us_confirmed_csv(spark, sf_dir):
    wide = read_wide_csv(spark, rendering.render_us_confirmed(spark, sf_dir))
    return _text(cleaning.us_horizontal(wide), "counts")


def q_load_us_confirmed_csv_vertical(spark, sf_dir):
    return cleaning.us_vertical(read_wide_csv(spark, rendering.render_us_confirmed(spark, sf_dir)))


def q_bad_series_rows(spark, sf_dir):
    wide = read_wide_csv(spark, rendering.render_global_bad(spark, sf_dir), flag_malformed=True)
    bad = cleaning.bad_series_rows(wide)
    return bad.select(F.col(f"`{bad.columns[1]}`").alias("country"), F.col("_corrupt_record").isNotNull().alias("malformed"))


def q_menu_4_from_raw(spark, sf_dir):
    frames = load_all(spark, rendering.render_folder(spark, sf_dir))
    return menu_query(4, frames, fx.calendar(spark, sf_dir).start_date, day_index=fx.DAY_INDEX)


def q_sql_over_views(spark, sf_dir):
    frames = load_all(spark, rendering.render_folder(spark, sf_dir))
    register_views({f"cumulus_{k}": v for k, v in frames.items()})
    return spark.sql(f"""
        SELECT c.country, count(*) AS n_places, sum(element_at(c.counts, {fx.DAY_INDEX})) AS confirmed,
               max(p.population) AS population
        FROM cumulus_global_confirmed c JOIN cumulus_places p ON p.country = c.country AND p.region IS NULL
        GROUP BY c.country""")


def q_csv_without_header(spark, sf_dir):
    path = scratch_path(spark, "no-header-csv")
    write_csv(fx.series_vertical(spark, sf_dir).select("country", "region", "date", "confirmed"), path)
    raw = read_table_csv(spark, path, header=False)
    c = [F.col(x) for x in raw.columns]
    return raw.select(c[0].alias("country"), c[1].alias("region"), c[2].try_cast("date").alias("date"), try_long(c[3]).alias("confirmed"))


def q_growth_hot_key(spark, sf_dir):
    # Three order states: two of them hold almost all rows.
    orders = fx.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey", "o_custkey")
    return growth_vertical_spread(orders, "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"], window_rows=4096)


def q_load_wide_releases(spark, sf_dir):
    wide = read_wide_releases(spark, rendering.render_releases(spark, sf_dir), keys=rendering.GLOBAL_HEADER[:2],
                              ids=rendering.GLOBAL_HEADER, aliases={"Province_State": rendering.GLOBAL_HEADER[0]})
    return _text(cleaning.global_horizontal(wide), "counts")


def q_load_multi_line_csv(spark, sf_dir):
    raw = read_table_csv(spark, rendering.render_documents(spark, sf_dir), multi_line="split")
    return raw.select(try_long("doc_id").alias("doc_id"), "source", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_wide_csv_round_trip(spark, sf_dir):
    start, _ = _calendar(spark, sf_dir)
    path = scratch_path(spark, "query1-csv")
    countries = _merged(spark, sf_dir).where(F.col("region").isNull())
    write_wide_csv(countries, path, GLOBAL_IDS, "confirmed", start)
    return _text(cleaning.global_horizontal(read_wide_csv(spark, path)).drop("region"), "counts")


def q_csv_single_file(spark, sf_dir):
    path = scratch_path(spark, "query2-single")
    write_csv(trends.global_count_vertical(_merged_vertical(spark, sf_dir)), path, include_header=True, single_file=True)
    back = rendering.read_back_vertical(spark, path)
    if len(back.inputFiles()) != 1:
        raise RuntimeError("the result was not written as one file")
    return back


def q_preview_log(spark, sf_dir):
    return preview_rows(fx.observation_log(spark, sf_dir).orderBy("id", "region", "country"), 20, truncate=8)


def q_top_incidence(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    ranked = rates.incidence(gs["confirmed"], fx.places(spark, sf_dir), day_index=fx.DAY_INDEX)
    return ranked.orderBy(F.col("incidence").desc_nulls_last(), "country").limit(10)


def q_death_rates_without_date(spark, sf_dir):
    gs = fx.global_series(spark, sf_dir)
    return rates.death_rates(gs["deaths"], gs["confirmed"], fx.DEATH_RATE_COUNTRIES)


def q_unmatched_countries(spark, sf_dir):
    return quarters.unmatched_countries(q_clean_observation_log(spark, sf_dir), fx.places(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "global_percent_by_quarter": q_global_percent_by_quarter,
    "us_percent_by_quarter": q_us_percent_by_quarter,
    "us_all_percent_by_quarter": q_us_all_percent_by_quarter,
    "incidence": q_incidence,
    "tropical_vs_non_tropical": q_tropical_vs_non_tropical,
    "incidence_with_counts": q_incidence_with_counts,
    "tropical_vs_non_tropical_by_country": q_tropical_vs_non_tropical_by_country,
    "death_rates": q_death_rates,
    "merge_global": q_merge_global,
    "merge_us": q_merge_us,
    "merge_global_vertical": q_merge_global_vertical,
    "merge_us_vertical": q_merge_us_vertical,
    "global_count_unpacked": q_global_count_unpacked,
    "global_count_vertical": q_global_count_vertical,
    "us_count_vertical": q_us_count_vertical,
    "growth_horizontal": q_growth_horizontal,
    "growth_vertical": q_growth_vertical,
    "growth_unpacked": q_growth_unpacked,
    "growth_vertical_us": q_growth_vertical_us,
    "to_horizontal_global": q_to_horizontal_global,
    "to_horizontal_us": q_to_horizontal_us,
    "to_vertical_global": q_to_vertical_global,
    "to_vertical_us": q_to_vertical_us,
    "dense_ordinal": q_dense_ordinal,
    "load_wide_csv": q_load_wide_csv,
    "parse_quoted_lines": q_parse_quoted_lines,
    "load_us_csv": q_load_us_csv,
    "load_wide_csv_vertical": q_load_wide_csv_vertical,
    "load_us_csv_vertical": q_load_us_csv_vertical,
    "clean_place_dim": q_clean_place_dim,
    "clean_observation_log": q_clean_observation_log,
    "parse_update_dates": q_parse_update_dates,
    "normalise_region": q_normalise_region,
    "normalise_country": q_normalise_country,
    "csv_round_trip": q_csv_round_trip,
    "global_count_unpacked_learned": q_global_count_unpacked_learned,
    "to_horizontal_sparse": q_to_horizontal_sparse,
    "ordinal_file_order": q_ordinal_file_order,
    "load_us_confirmed_csv": q_load_us_confirmed_csv,
    "load_us_confirmed_csv_vertical": q_load_us_confirmed_csv_vertical,
    "bad_series_rows": q_bad_series_rows,
    "menu_4_from_raw": q_menu_4_from_raw,
    "sql_over_views": q_sql_over_views,
    "csv_without_header": q_csv_without_header,
    "growth_hot_key": q_growth_hot_key,
    "load_wide_releases": q_load_wide_releases,
    "load_multi_line_csv": q_load_multi_line_csv,
    "wide_csv_round_trip": q_wide_csv_round_trip,
    "csv_single_file": q_csv_single_file,
    "preview_log": q_preview_log,
    "top_incidence": q_top_incidence,
    "death_rates_without_date": q_death_rates_without_date,
    "unmatched_countries": q_unmatched_countries,
}
