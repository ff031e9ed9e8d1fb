"""Epidemic-style inputs derived from the benchmark's Parquet tables.

The reference reads seven CSV files that are not shipped, so the same shapes are
derived here, as lazy Spark jobs over whole tables, from the tables the bench
provides (nation, customer, orders, events):

* ``places``           -- place dimension: one country row per nation, province
                          rows for every fifth nation (one per market segment).
                          (The series' own provinces, one per user, come from
                          ``events``; they share their nation's coordinates.)
* ``series_vertical``  -- cumulative daily counts per place from ``events``:
                          confirmed / deaths / recovered = running count of
                          view / error / purchase events, dense over the calendar.
* ``numbered_series``  -- the three measures packed into horizontal frames with row ids, with
                          deliberate asymmetries for the merges; stored by place key.
                          ``global_series`` and ``global_series_vertical`` are views of them.
* ``us_series``        -- the places with a region, in the US file layout; stored by uid.
* ``observation_log``  -- per (segment, nation, day) running counts of orders.

Everything scans its whole table. The heavy steps are the first aggregation of
``events`` and the ``orders``-``customer`` join; both aggregate map-side before
shuffling, so a place or customer holding a large share of rows costs no more
than its partial aggregate. Everything after that is one row per place and day.

The derived tables (daily event counts, places, vertical and numbered series, observation log) are
written once per session as Parquet below ``spark.checkpoint.dir`` and read back
(see ``session.materialize``): each is small next to its source, every query
reads it, and without this Catalyst would re-derive it per query branch (each
branch prunes and filters differently, so the scans are not shared). ``events``
and ``orders`` are each scanned once per session.
"""

from __future__ import annotations

import datetime as _dt
import functools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cumulus.operators.shapes import dense_ordinal, to_horizontal, to_vertical
from cumulus.schemas import GLOBAL_IDS, GLOBAL_KEYS, US_IDS
from cumulus.session import materialize, materialize_by_key

# Fixed values of the derivation (documented in FIXTURES.md).
N_COUNTRIES = 25            # country = NATION_(user_id mod 25)
PROVINCE_EVERY = 5          # nations whose key is a multiple of 5 have regions
# On those nations every user is a province: region = R(user_id div 25), so the
# number of places grows with the number of users (15 / 50 / 320 at sf 0.001 / 0.01 / 0.1).
NULL_LATITUDE_KEYS = (3, 9)  # latitude unknown (cleaned to 0.0)
BOUNDARY_LATITUDE_KEY = 24   # latitude exactly 23.5: in neither climate class
NULL_POPULATION_KEY = 7
MEASURE_EVENTS = {"confirmed": "view", "deaths": "error", "recovered": "purchase"}
DROPPED_FROM_DEATHS = "NATION_1"
COLLAPSED_IN_RECOVERED = "NATION_0"
FOCUS_COUNTRY = "NATION_0"   # stands in for "US"
FOCUS_UID = 0                # stands in for uid 840
LOG_BASE_YEAR = 1995
TWO_DIGIT_YEAR_PIVOT = 69     # the derived log starts in 1995: 69-99 are 19xx
DAY_INDEX = 30               # 1-based "final day" of the derived series
DEATH_RATE_COUNTRIES = ("NATION_0", "NATION_2", "NATION_3", "NATION_9", "NATION_10", "NATION_24")


# Builders are memoised per (session, folder): DataFrames are immutable and lazy,
# so sharing the objects caches no data, saves re-planning, and lets Spark see
# identical subtrees (and reuse their shuffles) when a query uses one twice.
_memo = functools.lru_cache(maxsize=256)


def reset() -> None:
    """Forget every memoised frame and value of this module (see ``catalog.reset``)."""
    for f in list(globals().values()):
        if hasattr(f, "cache_clear"):
            f.cache_clear()



@_memo
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _latitude(key: Column) -> Column:
    return (
        F.when(key.isin(*NULL_LATITUDE_KEYS), F.lit(0.0))
        .when(key == BOUNDARY_LATITUDE_KEY, F.lit(23.5))
        .otherwise(key * 4 - 45)
        .cast("float")
    )


def _longitude(key: Column) -> Column:
    return (key * 7 - 84).cast("float")


@_memo
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACTION (once per session and folder): the place dimension in the lookup-table
    schema (uid ... population), written below the checkpoint folder."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("country"))
    per_segment = (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").cast("bigint").alias("k"), F.col("c_mktsegment").alias("seg"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_nation = per_segment.groupBy("k").agg(F.sum("n").alias("n"))
    k = F.col("k")
    countries = nation.join(per_nation, "k", "left").select(
        k.alias("uid"),
        F.concat(F.lit("N"), k.cast("string")).alias("iso2"),
        F.concat(F.lit("NAT"), k.cast("string")).alias("iso3"),
        (k + 100).cast("int").alias("code3"),
        F.lit(None).cast("bigint").alias("FIPS"),
        F.lit(None).cast("string").alias("Admin2"),
        F.lit(None).cast("string").alias("region"),
        F.col("country"),
        _latitude(k).alias("latitude"),
        _longitude(k).alias("longitude"),
        F.col("country").alias("combined_key"),
        F.when(k == NULL_POPULATION_KEY, F.lit(None)).otherwise(F.col("n") * 1000).cast("bigint").alias("population"),
    )
    # Rank of the segment among all distinct segments, computed distributed (no
    # single-partition window over the values, however many there are).
    segments = dense_ordinal(per_segment.select("seg").distinct(), "seg_idx", order_by=["seg"])
    uid = F.lit(1000) + k * 10 + F.col("seg_idx")
    provinces = (
        per_segment.where(k % PROVINCE_EVERY == 0)
        .join(segments, "seg")
        .join(nation, "k")
        .select(
            uid.cast("bigint").alias("uid"),
            F.concat(F.lit("N"), k.cast("string")).alias("iso2"),
            F.concat(F.lit("NAT"), k.cast("string")).alias("iso3"),
            (k + 100).cast("int").alias("code3"),
            uid.cast("bigint").alias("FIPS"),
            F.lit(None).cast("string").alias("Admin2"),
            F.col("seg").alias("region"),
            F.col("country"),
            _latitude(k).alias("latitude"),
            _longitude(k).alias("longitude"),
            F.concat_ws(", ", F.col("seg"), F.col("country")).alias("combined_key"),
            (F.col("n") * 1000).cast("bigint").alias("population"),
        )
    )
    return materialize(countries.unionByName(provinces), "places")


@_memo
def country_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, latitude, longitude) of the country rows; depends on ``nation`` only."""
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("country"), _latitude(k).alias("latitude"), _longitude(k).alias("longitude"))


@dataclass(frozen=True)
class Calendar:
    """First day and number of days of the derived series."""

    start_date: _dt.date
    n_days: int

    @property
    def start(self) -> Column:
        return F.lit(self.start_date).cast("date")

    @property
    def last(self) -> Column:
        return F.lit(self.start_date + _dt.timedelta(days=self.n_days - 1)).cast("date")


@_memo
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACTION (once per session and folder): per (region, country, day), how many
    events of each measure's type.

    Grouped on the integer place keys (nation and region number) with map-side
    partial aggregation; the region and country names are built afterwards, on
    one row per place and day rather than on every event.
    """
    uid = F.col("user_id")
    nk = (uid % N_COUNTRIES).cast("int")
    rk = F.when(nk % PROVINCE_EVERY == 0, F.expr(f"user_id div {N_COUNTRIES}"))
    daily = table(spark, sf_dir, "events").groupBy(
        nk.alias("nk"), rk.alias("rk"), F.to_date("ts").alias("date")
    ).agg(*[F.count_if(F.col("event_type") == t).alias(m) for m, t in MEASURE_EVENTS.items()])
    named = daily.select(
        F.when(F.col("rk").isNotNull(), F.concat(F.lit("R"), F.col("rk").cast("string"))).alias("region"),
        F.concat(F.lit("NATION_"), F.col("nk").cast("string")).alias("country"),
        "date", *MEASURE_EVENTS,
    )
    # Written once: the calendar and the series both read it, so ``events`` is
    # scanned exactly once.
    return materialize(named, "daily-events")


@_memo
def calendar(spark: SparkSession, sf_dir: str) -> Calendar:
    """ACTION (once per session and folder): first and last event day.

    One global aggregate over the written daily table (not over ``events``)
    returning a single row. The bounds then enter every plan as literals, instead
    of as scalar subqueries that each re-scan the source.
    """
    row = daily_events(spark, sf_dir).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if row["lo"] is None:
        return Calendar(_dt.date(1970, 1, 1), 0)
    return Calendar(row["lo"], (row["hi"] - row["lo"]).days + 1)


@_memo
def series_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACTION (once per session and folder): cumulative counts per place and day,
    dense over the calendar.

    Columns: region, country, latitude, longitude, date, confirmed, deaths, recovered.
    The calendar is every day from the first to the last event day; each place
    seen gets every day (0 before its first event). The dense grid is generated
    per place with ``explode(sequence(first, last))`` -- no cross join -- and the
    running totals are a window per place (one partition per place, one row per day).
    """
    daily = daily_events(spark, sf_dir)
    cal = calendar(spark, sf_dir)
    grid = daily.select("region", "country").distinct().select(
        "region", "country",
        F.explode(F.sequence(cal.start, cal.last)).alias("date"),
    ).where(F.lit(cal.n_days > 0))
    d = daily.alias("d")
    g = grid.alias("g")
    dense = g.join(
        d,
        F.col("g.region").eqNullSafe(F.col("d.region"))
        & (F.col("g.country") == F.col("d.country"))
        & (F.col("g.date") == F.col("d.date")),
        "left",
    ).select(
        "g.region", "g.country", "g.date",
        *[F.coalesce(F.col(f"d.{m}"), F.lit(0)).alias(m) for m in MEASURE_EVENTS],
    )
    running = Window.partitionBy("region", "country").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cumulative = dense.select(
        "region", "country", "date",
        *[F.sum(m).over(running).cast("bigint").alias(m) for m in MEASURE_EVENTS],
    )
    series = cumulative.join(country_coordinates(spark, sf_dir), "country", "left").select(
        "region", "country",
        F.coalesce("latitude", F.lit(0.0).cast("float")).alias("latitude"),
        F.coalesce("longitude", F.lit(0.0).cast("float")).alias("longitude"),
        "date", *MEASURE_EVENTS,
    )
    return materialize(series, "series")


@_memo
def numbered_series(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """ACTION (once per session and folder): the horizontal frames of the three measures with their row ``id``
    (the rank by country and region), each stored by place key. Merges of them and windows per
    place, also of the vertical rows exploded from them, need no exchange.

    ``deaths`` lacks NATION_1, and ``recovered`` has NATION_0's regions summed into
    one country-level row, so the three-way merge meets left-only, right-only and
    matched rows.
    """
    v = series_vertical(spark, sf_dir)
    cal = calendar(spark, sf_dir)
    # confirmed and deaths come from one packing pass; recovered needs its own grouping.
    packed = to_horizontal(v, GLOBAL_IDS, ["confirmed", "deaths"], cal.start, cal.n_days)
    collapsed = v.select(
        F.when(F.col("country") == COLLAPSED_IN_RECOVERED, F.lit(None)).otherwise(F.col("region")).alias("region"),
        "country", "latitude", "longitude", "date", "recovered",
    ).groupBy(*GLOBAL_IDS, "date").agg(F.sum("recovered").alias("recovered"))
    recovered = to_horizontal(collapsed, GLOBAL_IDS, "recovered", cal.start, cal.n_days)
    # One numbering pass over the places of all three files.
    both = packed.select(*GLOBAL_IDS, F.explode(F.array(
        F.struct(F.lit("confirmed").alias("_file"), F.col("confirmed").alias("counts")),
        F.when(F.col("country") != DROPPED_FROM_DEATHS, F.struct(F.lit("deaths").alias("_file"), F.col("deaths").alias("counts"))))).alias("_m"))
    files = both.where("_m IS NOT NULL").select(*GLOBAL_IDS, "_m.*").unionByName(recovered.withColumn("_file", F.lit("recovered")))
    numbered = dense_ordinal(files, "id", order_by=["country", "region"], within=["_file"])
    with ThreadPoolExecutor(max_workers=3) as pool:
        stored = {m: pool.submit(materialize_by_key, numbered.where(F.col("_file") == m).select("id", *GLOBAL_IDS, "counts"),
                                 f"series-{m}", GLOBAL_KEYS) for m in MEASURE_EVENTS}
        return {m: f.result() for m, f in stored.items()}


def global_series(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Horizontal (region, country, latitude, longitude, counts) frames per measure (see :func:`numbered_series`)."""
    return {m: df.drop("id") for m, df in numbered_series(spark, sf_dir).items()}


def global_series_vertical(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One row per place and day (id, region, country, latitude, longitude, date, counts) per measure; narrow."""
    start = calendar(spark, sf_dir).start
    return {m: to_vertical(df, ["id", *GLOBAL_IDS], start, id_col=None) for m, df in numbered_series(spark, sf_dir).items()}


@_memo
def us_series(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """ACTION (once per session and folder): places with a region in the US file layout, stored by ``uid``:
    ``confirmed`` without and ``deaths`` with population (the country row's)."""
    v = series_vertical(spark, sf_dir).where(F.col("region").isNotNull())
    cal = calendar(spark, sf_dir)
    # uid = 1,000,000 + the user's id (each province is one user): unique at any size.
    nk = F.substring(F.col("country"), 8, 64).cast("bigint")
    rk = F.substring(F.col("region"), 2, 64).cast("bigint")
    uid = (F.lit(1_000_000) + nk + rk * N_COUNTRIES).cast("bigint")
    country_rows = places(spark, sf_dir).where(F.col("region").isNull()).select(
        "country", "iso2", "iso3", "code3", F.col("population"))
    ided = v.join(country_rows, "country", "left").select(
        uid.alias("uid"), "iso2", "iso3", "code3", uid.alias("FIPS"),
        F.col("region").alias("Admin2"), "region", "country", "latitude", "longitude",
        F.concat_ws(", ", "region", "country").alias("combined_key"),
        "population", "date", "confirmed", "deaths",
    )
    packed = to_horizontal(ided, [*US_IDS, "population"], ["confirmed", "deaths"], cal.start, cal.n_days)
    stored = materialize_by_key(packed, "us-series", ["uid"])
    return {"confirmed": stored.select(*US_IDS, F.col("confirmed").alias("counts")),
            "deaths": stored.select(*US_IDS, F.col("deaths").alias("counts"), "population")}


@_memo
def observation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACTION (once per session and folder): observation log. Per (segment, nation,
    order day): the running number of orders (confirmed), of status F orders
    (deaths) and of status P orders (recovered).

    Columns: id (smallest order key of the day), observed_date, region, country,
    last_updated, confirmed, deaths, recovered.

    ``orders`` joins ``customer`` on the customer key (the one large shuffle; AQE
    splits a skewed key), then the tiny ``nation``. The day aggregate is partial
    before its shuffle; the running window has one partition per (segment, nation).
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("observed_date"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    located = customers.join(nation, customers.c_nationkey == nation.n_nationkey)
    joined = orders.join(located, orders.o_custkey == located.c_custkey)
    daily = joined.groupBy(
        F.col("c_mktsegment").alias("region"), F.col("n_name").alias("country"), "observed_date"
    ).agg(
        F.min("o_orderkey").cast("bigint").alias("id"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("f"),
        F.count_if(F.col("o_orderstatus") == "P").alias("p"),
    )
    running = Window.partitionBy("region", "country").orderBy("observed_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    log = daily.select(
        "id", "observed_date", "region", "country",
        F.col("observed_date").alias("last_updated"),
        F.sum("n").over(running).cast("bigint").alias("confirmed"),
        F.sum("f").over(running).cast("bigint").alias("deaths"),
        F.sum("p").over(running).cast("bigint").alias("recovered"),
    )
    return materialize(log, "observation-log")


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """ACTION: derive and write the input tables, as concurrent Spark jobs.

    They are independent, so they are submitted from three driver threads and
    share the cluster instead of running one after the other. Later calls of the
    builders return the written tables.
    """
    # places and the log start at once; the series waits for the daily counts and
    # the calendar, which it is built from.
    with ThreadPoolExecutor(max_workers=3) as pool:
        futures = [pool.submit(fn, spark, sf_dir) for fn in (numbered_series, places, observation_log)]
        for f in futures:
            f.result()
