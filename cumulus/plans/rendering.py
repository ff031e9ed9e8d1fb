"""Render the derived inputs as the raw text files the reference reads (FIXTURES F6).

Each function writes one file set below the session's checkpoint folder (a
shared folder on a cluster) and returns its paths: the rendered frame as CSV
part files written in parallel, and a small file of hand-written edge rows
(quoted commas, escaped quotes, trailing empty fields, empty coordinates,
every date layout, odd place names). Reading these back through ``sources``
and ``operators.cleaning`` must give the typed frames again.

The rendered files stand for the raw inputs the reference finds on disk, so each
is written once per session and folder (memoised, like the derived tables); the
queries then read and clean them.
"""

from __future__ import annotations

import datetime as _dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.plans import fixtures as fx
from cumulus.session import scratch_path
from cumulus.sinks.csv import write_csv, write_wide_csv
from cumulus.sources.catalog import INPUT_FILES

_once = functools.lru_cache(maxsize=64)


def reset() -> None:
    """Forget the rendered files (see ``catalog.reset``)."""
    for f in list(globals().values()):
        if hasattr(f, "cache_clear"):
            f.cache_clear()


GLOBAL_HEADER = ["Province/State", "Country/Region", "Lat", "Long"]
US_HEADER = ["UID", "iso2", "iso3", "code3", "FIPS", "Admin2", "Province_State", "Country_Region",
             "Lat", "Long_", "Combined_Key"]
PLACE_HEADER = [*US_HEADER, "Population"]
LOG_HEADER = ["SNo", "ObservationDate", "Province/State", "Country/Region", "Last Update",
              "Confirmed", "Deaths", "Recovered"]

# Spark datetime patterns of the five "last updated" layouts, chosen by id mod 5.
UPDATE_RENDER_FORMATS = ("M/d/yyyy H:mm", "M/d/yy HH:mm", "M/d/yy H:mm",
                         "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def calendar_values(spark: SparkSession, sf_dir: str) -> tuple[_dt.date, int]:
    """First day and number of days of the derived series (see ``fixtures.calendar``)."""
    cal = fx.calendar(spark, sf_dir)
    return cal.start_date, cal.n_days


def _write_lines(spark: SparkSession, path: str, header: str, lines: list[str]) -> None:
    spark.createDataFrame([(header,), *[(ln,) for ln in lines]], "value string").coalesce(1).write.text(path)


def _first_line(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).limit(1).collect()[0][0]


def _unknown_latitude(lat: Column, country: Column) -> Column:
    unknown = [f"NATION_{k}" for k in fx.NULL_LATITUDE_KEYS]
    return F.when(country.isin(*unknown), F.lit(None).cast("float")).otherwise(lat)


def global_edge_lines(n_days: int) -> list[str]:
    """Hand-written rows of a wide global file with ``n_days`` day columns."""
    full = ",".join(str(i) for i in range(1, n_days + 1))
    short = ",".join(str(i) for i in range(1, n_days)) + ","
    return [
        f',"Korea, South",36.0,128.0,{full}',
        f'"x ""y"" z",EDGE_B,2.0,3.0,{full}',
        f",EDGE_A,2.0,3.0,{short}",
        f",EDGE_SHIP,,,{full}",
    ]


def quoted_edge_lines(n_days: int) -> list[str]:
    """Raw lines with quotes after a blank, inside a field and around a field of 100,000 characters."""
    full = ",".join(str(i) for i in range(1, n_days + 1))
    return [
        f', "Blank, Before",1.0,2.0,{full}',
        f'abc "x, y",INSIDE,1.0,2.0,{full}',
        f'"a"b"c,d",TWICE,1.0,2.0,{full}',
        f'"{"x," * 50_000}",LONG,1.0,2.0,{full}',
    ]


def _write_global(spark: SparkSession, sf_dir: str, measure: str, path: str) -> None:
    start, n_days = calendar_values(spark, sf_dir)
    h = fx.global_series(spark, sf_dir)[measure]
    raw = h.select(
        F.col("region").alias(GLOBAL_HEADER[0]), F.col("country").alias(GLOBAL_HEADER[1]),
        _unknown_latitude(F.col("latitude"), F.col("country")).alias(GLOBAL_HEADER[2]),
        F.col("longitude").alias(GLOBAL_HEADER[3]), "counts",
    )
    write_wide_csv(raw, path, GLOBAL_HEADER, "counts", start, n_days, quote_all=True)


@_once
def render_global(spark: SparkSession, sf_dir: str, measure: str = "confirmed") -> list[str]:
    """ACTION (once per session): the global series of ``measure`` as a wide file, plus
    edge rows. Returns the paths."""
    main = scratch_path(spark, f"global-{measure}")
    _write_global(spark, sf_dir, measure, main)
    edges = scratch_path(spark, f"global-{measure}-edges")
    _write_lines(spark, edges, _first_line(spark, main), global_edge_lines(calendar_values(spark, sf_dir)[1]))
    return [main, edges]


def bad_global_lines(n_days: int) -> list[str]:
    """Hand-written rows of a wide global file: the first is good, the others are not."""
    full = ",".join(str(i) for i in range(1, n_days + 1))
    return [
        f",GOOD,1.0,2.0,{full}",
        f",BAD_LATITUDE,north,2.0,{full}",
        f",BAD_COUNT,1.0,2.0,{full[:-len(str(n_days))]}many",
        f",TOO_LONG,1.0,2.0,{full},7",
        f",TOO_SHORT,1.0,2.0,{full.rpartition(',')[0]}",
    ]


@_once
def render_quoted(spark: SparkSession, sf_dir: str) -> list[str]:
    """ACTION (once per session): the confirmed file with its edge rows, and raw lines with odd quoting."""
    paths = render_global(spark, sf_dir, "confirmed")
    edges = scratch_path(spark, "global-quoted-edges")
    _write_lines(spark, edges, _first_line(spark, paths[0]), quoted_edge_lines(calendar_values(spark, sf_dir)[1]))
    return [*paths, edges]


@_once
def render_global_bad(spark: SparkSession, sf_dir: str) -> list[str]:
    """ACTION (once per session): the confirmed file, and rows of which four are malformed or unparsable."""
    main = render_global(spark, sf_dir, "confirmed")[0]
    edges = scratch_path(spark, "global-bad-edges")
    _write_lines(spark, edges, _first_line(spark, main), bad_global_lines(calendar_values(spark, sf_dir)[1]))
    return [main, edges]


@_once
def render_releases(spark: SparkSession, sf_dir: str) -> list[str]:
    """ACTION (once per session): the confirmed series in two releases. The older has the first two thirds of the
    days, those of the middle third still one too high; the newer has the last two thirds, its columns in another order and
    one spelt otherwise, and lacks NATION_2."""
    start, n_days = calendar_values(spark, sf_dir)
    a, b = n_days // 3, n_days - n_days // 3
    h = fx.global_series(spark, sf_dir)["confirmed"].select(*[F.col(c).alias(n) for c, n in zip(
        ["region", "country", "latitude", "longitude"], GLOBAL_HEADER)], "counts")
    older = h.withColumn("counts", F.transform(F.slice("counts", 1, b), lambda v, i: F.when(i >= a, v + 1).otherwise(v)))
    newer = h.where(F.col(f"`{GLOBAL_HEADER[1]}`") != "NATION_2").withColumn("counts", F.slice("counts", a + 1, n_days)).withColumnRenamed(
        GLOBAL_HEADER[0], "Province_State")
    folders = [scratch_path(spark, f"release-{x}") for x in ("older", "newer")]
    write_wide_csv(older, folders[0], GLOBAL_HEADER, "counts", start, b)
    write_wide_csv(newer, folders[1], [GLOBAL_HEADER[1], "Province_State", *GLOBAL_HEADER[2:]], "counts", start + _dt.timedelta(days=a), n_days - a)
    return folders


@_once
def render_documents(spark: SparkSession, sf_dir: str) -> str:
    """ACTION (once per session): the documents table as one CSV file with line breaks inside its quoted texts."""
    path = scratch_path(spark, "documents-csv")
    write_csv(fx.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, include_header=True, single_file=True,
              quote_all=True)
    return path


def _write_us(spark: SparkSession, sf_dir: str, measure: str, path: str) -> None:
    start, n_days = calendar_values(spark, sf_dir)
    h = fx.us_series(spark, sf_dir)[measure]
    more = ["population"] if measure == "deaths" else []
    names = US_HEADER + ["Population"] * len(more)
    raw = h.select(
        *[F.col(c).alias(n) for c, n in zip(["uid", "iso2", "iso3", "code3"], US_HEADER[:4])],
        F.format_string("%d.0", F.col("FIPS")).alias("FIPS"),
        *[F.col(c).alias(n) for c, n in zip(["Admin2", "region", "country", "latitude", "longitude",
                                               "combined_key", *more], names[5:])],
        "counts",
    )
    write_wide_csv(raw, path, names, "counts", start, n_days)


@_once
def render_us_deaths(spark: SparkSession, sf_dir: str) -> list[str]:
    """ACTION: the US-layout deaths series (with population, FIPS as float text)."""
    main = scratch_path(spark, "us-deaths")
    _write_us(spark, sf_dir, "deaths", main)
    return [main]


def us_edge_lines(n_days: int) -> list[str]:
    """A row of a US confirmed file without codes and coordinates (its typed values are in the oracle SQL)."""
    full = ",".join(str(i) for i in range(1, n_days + 1))
    return [f'9900001,EE,EDG,,,"Edge, Town",EDGE_R,EDGE_US,,,"Edge, Town, EDGE_US",{full}']


@_once
def render_us_confirmed(spark: SparkSession, sf_dir: str) -> list[str]:
    """ACTION: the US-layout confirmed series (no population), plus an edge row."""
    main = scratch_path(spark, "us-confirmed")
    _write_us(spark, sf_dir, "confirmed", main)
    edges = scratch_path(spark, "us-confirmed-edges")
    _write_lines(spark, edges, _first_line(spark, main), us_edge_lines(calendar_values(spark, sf_dir)[1]))
    return [main, edges]


@_once
def render_folder(spark: SparkSession, sf_dir: str) -> str:
    """ACTION (once per session): all seven raw inputs in one folder, under their usual names."""
    folder = scratch_path(spark, "raw-inputs")
    at = lambda key: f"{folder}/{INPUT_FILES[key]}"
    for m in ("confirmed", "deaths", "recovered"):
        _write_global(spark, sf_dir, m, at(f"global_{m}"))
    for m in ("confirmed", "deaths"):
        _write_us(spark, sf_dir, m, at(f"us_{m}"))
    _write_places(spark, sf_dir, at("places"))
    _write_log(spark, sf_dir, at("observation_log"))
    return folder


# Hand-written place rows (uid 9001-9003) and their typed values are listed in
# the oracle SQL; keep the two in step.
PLACE_EDGE_LINES = [
    '9001,KR,KOR,410,,,,"Korea, South",36.0,128.0,"Korea, South",51269183',
    "9002,,,,,,,EDGE_SHIP,,,EDGE_SHIP,",
    '9003,US,USA,840,1001.0,Autauga,Alabama,US,32.5,-86.6,"Autauga, Alabama, US",55869',
]


def _write_places(spark: SparkSession, sf_dir: str, path: str) -> None:
    p = fx.places(spark, sf_dir)
    cols = ["uid", "iso2", "iso3", "code3", "FIPS", "Admin2", "region", "country", "latitude", "longitude",
            "combined_key", "population"]
    raw = p.withColumn("latitude", F.when(F.col("region").isNull(),
                                          _unknown_latitude(F.col("latitude"), F.col("country")))
                       .otherwise(F.col("latitude")))
    write_csv(raw.select(*[F.col(c).alias(n) for c, n in zip(cols, PLACE_HEADER)]), path, include_header=True)


@_once
def render_places(spark: SparkSession, sf_dir: str) -> list[str]:
    """ACTION: the place dimension as a lookup file (unknown latitudes empty), plus edge rows."""
    main = scratch_path(spark, "places")
    _write_places(spark, sf_dir, main)
    edges = scratch_path(spark, "places-edges")
    _write_lines(spark, edges, ",".join(PLACE_HEADER), PLACE_EDGE_LINES)
    return [main, edges]


# Hand-written log rows (ids 1-7); their typed values are listed in the oracle SQL.
LOG_EDGE_LINES = [
    "1,01/22/2020,Diamond Princess cruise ship,Others,1/22/2020 17:00,12.0,1.0,0.0",
    "2,01/22/2020,None,\"('St. Martin',)\",1/22/20 17:00,12,0,0",
    '3,01/23/2020,Unknown,"Bahamas, The",1/22/20 7:00,3.0,,1.0',
    "4,01/23/2020,Grand Princess,Canada,2020-02-01T19:53:03,5.0,0.0,0.0",
    "5,01/24/2020,NATION_3,NATION_3,2020-03-08 05:31:00,7.0,1.0,2.0",
    "6,01/24/2020, Hubei ,The Gambia,Jan 22,1.0,0.0,0.0",
    '7,01/24/2020,,"  Spain ",1/22/20 0:30,2.0,0.0,0.0',
]


def update_text(observed: Column, id_col: Column) -> Column:
    """Render a "last updated" value from the day and row id, in layout ``id mod 5``."""
    ts = F.make_timestamp_ntz(F.year(observed), F.month(observed), F.dayofmonth(observed),
                              (id_col % 24).cast("int"), (id_col % 60).cast("int"), F.lit(0))
    form = id_col % 5
    expr = None
    for i, fmt in enumerate(UPDATE_RENDER_FORMATS):
        txt = F.date_format(ts, fmt)
        expr = F.when(form == i, txt) if expr is None else expr.when(form == i, txt)
    return expr


def _write_log(spark: SparkSession, sf_dir: str, path: str) -> None:
    log = fx.observation_log(spark, sf_dir)
    raw = log.select(
        F.col("id").alias(LOG_HEADER[0]),
        F.date_format("observed_date", "MM/dd/yyyy").alias(LOG_HEADER[1]),
        F.col("region").alias(LOG_HEADER[2]), F.col("country").alias(LOG_HEADER[3]),
        update_text(F.col("observed_date"), F.col("id")).alias(LOG_HEADER[4]),
        *[F.concat(F.col(m).cast("string"), F.lit(".0")).alias(n)
          for m, n in zip(["confirmed", "deaths", "recovered"], LOG_HEADER[5:])],
    )
    write_csv(raw, path, include_header=True, quote_all=True)


@_once
def render_log(spark: SparkSession, sf_dir: str) -> list[str]:
    """ACTION: the observation log as text (every field quoted, measures as "N.0"), plus edge rows."""
    main = scratch_path(spark, "log")
    _write_log(spark, sf_dir, main)
    edges = scratch_path(spark, "log-edges")
    _write_lines(spark, edges, ",".join(LOG_HEADER), LOG_EDGE_LINES)
    return [main, edges]


def read_back_vertical(spark: SparkSession, path: str) -> DataFrame:
    """Typed read of a written Query-2 result (id, country, latitude, longitude, date, confirmed)."""
    from cumulus.sources.csv import read_table_csv

    df = read_table_csv(spark, path)
    return df.select(
        F.col("id").try_cast("bigint").alias("id"), "country",
        F.col("latitude").try_cast("float").alias("latitude"),
        F.col("longitude").try_cast("float").alias("longitude"),
        F.col("date").try_cast("date").alias("date"),
        F.col("confirmed").try_cast("bigint").alias("confirmed"),
    )
