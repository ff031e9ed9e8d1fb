import datetime as dt

from cumulus.plans import quarters, rates

PL = ("uid bigint, region string, country string, latitude float, population bigint")
H = "region string, country string, latitude float, longitude float, counts array<bigint>"


def places(spark, rows):
    return spark.createDataFrame(rows, PL)


def naive_tropical(series, pl, day):
    out = {}
    for climate, test in (("tropical", lambda a: abs(a) < 23.5), ("non-tropical", lambda a: abs(a) > 23.5)):
        c = p = None
        for s in series:
            for u in pl:
                if s[2] == u[3] and test(u[3]):
                    v = s[4][day - 1] if len(s[4]) >= day else None
                    if v is not None:
                        c = (c or 0) + v
                    if u[4] is not None:
                        p = (p or 0) + u[4]
        out[climate] = (c, p)
    return out


def test_tropical_matches_pair_sum_with_hot_key(spark):
    # latitude 0.0 is shared by many series and many places (the "unknown" hot key)
    series = [(None, f"S{i}", 0.0, 0.0, [i, i + 1]) for i in range(6)] + [
        (None, "N", 40.0, 0.0, [7, 9]), ("R", "M", 40.0, 0.0, [1]), (None, "B", 23.5, 0.0, [5, 5])]
    pl = [(i, None, f"P{i}", 0.0, 100 + i) for i in range(4)] + [
        (10, None, "N", 40.0, 1000), (11, "X", "N", 40.0, None), (12, None, "B", 23.5, 9)]
    got = {r.climate: (r.sum_confirmed, r.sum_population)
           for r in rates.tropical_vs_non_tropical(spark.createDataFrame(series, H), places(spark, pl), 2).collect()}
    assert got == naive_tropical(series, pl, 2)


def test_tropical_always_two_rows(spark):
    s = spark.createDataFrame([(None, "A", 50.0, 0.0, [1])], H)
    got = rates.tropical_vs_non_tropical(s, places(spark, [(1, None, "A", 50.0, 10)]), 1).collect()
    assert {r.climate: (r.sum_confirmed, r.incidence) for r in got} == {"tropical": (None, None),
                                                                       "non-tropical": (1, 0.1)}


def test_incidence_null_and_zero_population(spark):
    s = spark.createDataFrame([(None, "A", 0.0, 0.0, [5, 10]), (None, "B", 0.0, 0.0, [5]), (None, "C", 0.0, 0.0, [1, 2])], H)
    pl = places(spark, [(1, None, "A", 0.0, 100), (2, None, "B", 0.0, 10), (3, None, "C", 0.0, 0)])
    got = {r.country: r.incidence for r in rates.incidence(s, pl, day_index=2).collect()}
    assert got == {"A": 0.1, "B": None, "C": None}


def test_death_rates_zip_and_divide_by_zero(spark):
    d = spark.createDataFrame([(None, "A", 0.0, 0.0, [0, 1, 2])], H)
    c = spark.createDataFrame([(None, "A", 0.0, 0.0, [0, 4]), (None, "Z", 0.0, 0.0, [1])], H)
    got = [tuple(r) for r in rates.death_rates(d, c, ["A"], with_date=True, start_date=dt.date(2020, 1, 1))
           .orderBy("date").collect()]
    assert got == [("A", dt.date(2020, 1, 1), 0, 0, None), ("A", dt.date(2020, 1, 2), 1, 4, 0.25),
                   ("A", dt.date(2020, 1, 3), 2, None, None)]


def test_quarter_totals_and_missing_uid(spark):
    log = spark.createDataFrame(
        [(dt.date(2020, 1, 5), "US", 1), (dt.date(2020, 3, 5), "US", 4), (dt.date(2020, 4, 1), "US", 6),
         (dt.date(2020, 6, 1), "US", 10)], "observed_date date, country string, confirmed bigint")
    pl = places(spark, [(840, None, "US", 0.0, 100)])
    got = {r.quarter: (r.quarter_total_confirmed, r.quarter_total_confirmed_percent)
           for r in quarters.us_percent_by_quarter(log, pl).collect()}
    assert got == {1: (3, 0.03), 2: (4, 0.04)}
    none = quarters.us_percent_by_quarter(log, pl, uid=1).collect()
    assert all(r.quarter_total_confirmed_percent is None for r in none)


def test_unmatched_countries(spark):
    log = spark.createDataFrame([("US",), ("Atlantis",)], "country string")
    pl = places(spark, [(840, None, "US", 0.0, 100)])
    assert [r.country for r in quarters.unmatched_countries(log, pl).collect()] == ["Atlantis"]
