"""Shape of the inputs derived from the bench tables (FIXTURES.md), at sf0.001."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from cumulus.operators import merge_global
from cumulus.plans import fixtures as fx


def test_places(spark):
    p = fx.places(spark, SF_SMALL)
    countries = p.where(F.col("region").isNull())
    assert countries.count() == 25 and countries.select("uid").distinct().count() == 25
    assert p.select("uid").distinct().count() == p.count()
    lat = {r.country: r.latitude for r in countries.collect()}
    assert lat["NATION_3"] == lat["NATION_9"] == 0.0 and lat["NATION_24"] == 23.5 and lat["NATION_0"] == -45.0
    assert countries.where("country = 'NATION_7'").first().population is None
    # provinces only for every fifth nation, with that nation's latitude
    prov = p.where(F.col("region").isNotNull()).collect()
    assert prov and all(int(r.country.split("_")[1]) % 5 == 0 and r.latitude == lat[r.country] for r in prov)


def test_series_dense_and_cumulative(spark):
    v = fx.series_vertical(spark, SF_SMALL)
    cal = fx.calendar(spark, SF_SMALL)
    places = v.select("region", "country").distinct().count()
    assert cal.n_days == 30 and places == 15 and v.count() == places * cal.n_days
    w = v.groupBy("region", "country").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.sort_array(F.collect_list(F.struct("date", "confirmed"))).alias("s")).collect()
    for r in w:
        vals = [x.confirmed for x in r.s]
        assert vals == sorted(vals)  # cumulative: never decreases
        assert (r.lo, r.hi) == (cal.start_date, cal.start_date + dt.timedelta(days=cal.n_days - 1))


def test_global_merge_asymmetry(spark):
    gs = fx.global_series(spark, SF_SMALL)
    m = merge_global(gs["confirmed"], gs["deaths"], gs["recovered"]).collect()
    keys = {(r.region, r.country) for r in m}
    assert len(m) == 16 and (None, "NATION_0") in keys
    only_recovered = [r for r in m if r.confirmed is None]
    assert [(r.region, r.country) for r in only_recovered] == [(None, "NATION_0")]
    assert all(r.deaths is None for r in m if r.country == "NATION_1")


def test_observation_log(spark):
    log = fx.observation_log(spark, SF_SMALL)
    assert log.select("id").distinct().count() == log.count()
    assert log.where("observed_date != last_updated").count() == 0
    assert log.where("deaths > confirmed OR recovered > confirmed").count() == 0


def test_prepare_all_then_queries_write_nothing(spark):
    import glob
    import os

    import __spark_entry__ as entry
    from cumulus.plans.catalog import prepare_all
    from cumulus.session import ensure_checkpoint_dir, local_path

    prepare_all(spark, SF_SMALL)
    scratch = os.path.join(local_path(ensure_checkpoint_dir(spark)), "cumulus-scratch")
    before = set(glob.glob(scratch + "/*"))
    for key in ("global_count_vertical", "merge_global", "incidence", "global_percent_by_quarter"):
        entry.queries()[key](spark, SF_SMALL).collect()
    assert set(glob.glob(scratch + "/*")) == before
