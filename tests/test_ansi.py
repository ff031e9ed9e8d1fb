"""Every public job runs under ANSI mode on hostile input: division by zero, short,
empty and null arrays, unparsable and out-of-range text. Nothing may raise."""

import datetime as dt

from pyspark.sql import functions as F

from cumulus.functions import code_or_zero, float_text_long, measure_long, try_long, update_date
from cumulus.operators import growth_horizontal, merge_global, to_unpacked, to_vertical
from cumulus.plans import quarters, rates

H = "region string, country string, latitude float, longitude float, counts array<bigint>"


def test_ansi_is_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_hostile_series(spark):
    rows = [(None, "A", 0.0, 0.0, [0, 0]), (None, "B", 0.0, 0.0, []), (None, "C", 50.0, 0.0, None),
            ("R", "A", 0.0, 0.0, [9223372036854775807, None])]
    s = spark.createDataFrame(rows, H)
    pl = spark.createDataFrame([(1, None, "A", 0.0, 0), (2, None, "B", 0.0, None), (3, None, "C", 50.0, 5)],
                               "uid bigint, region string, country string, latitude float, population bigint")
    rates.incidence(s, pl, day_index=99).collect()
    # (a true total past 2**63 raises under ANSI, as a plain SUM would)
    rates.tropical_vs_non_tropical(s.where(F.col("region").isNull()), pl, day_index=1).collect()
    rates.death_rates(s, s, ["A", "B", "C"]).collect()
    growth_horizontal(s, "counts").collect()
    to_vertical(s, ["region", "country"], dt.date(2020, 1, 1)).collect()
    to_unpacked(s, ["country"], "counts", dt.date(2020, 1, 1), 5).collect()
    merge_global(s, s.limit(1), s.where(F.col("country") == "Z")).collect()
    log = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 5), (dt.date(2020, 1, 2), "A", 2)],
                                "observed_date date, country string, confirmed bigint")
    quarters.global_percent_by_quarter(log, pl).collect()


def test_hostile_text(spark):
    vals = ["99999999999999999999", "1e400", "-", "NaN", "12.0.0", "٣", "0x10", "  ", "9/9/99 99:99"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    out = df.select(try_long("v"), measure_long("v"), float_text_long("v"), code_or_zero("v", "int"),
                    update_date("v")).collect()
    assert len(out) == len(vals)


def test_dates_independent_of_session_zone_and_ansi(spark):
    vals = ["1/22/2020 17:00", "1/22/20 0:30", "2020-03-08 02:30:00", "2020-02-01T23:59:59", "3/8/20 2:30"]
    want = [dt.date(2020, 1, 22), dt.date(2020, 1, 22), dt.date(2020, 3, 8), dt.date(2020, 2, 1), dt.date(2020, 3, 8)]
    old_tz, old_ansi = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.ansi.enabled")
    try:
        for tz, ansi in (("America/Los_Angeles", "false"), ("Asia/Kolkata", "true"), ("UTC", "true")):
            spark.conf.set("spark.sql.session.timeZone", tz)
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(update_date("v")).collect()]
            assert got == want, (tz, ansi, got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
        spark.conf.set("spark.sql.ansi.enabled", old_ansi)
