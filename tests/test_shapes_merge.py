import datetime as dt

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import Window

from cumulus.operators import (
    dense_ordinal,
    growth_horizontal,
    growth_vertical,
    merge_global,
    merge_us,
    to_horizontal,
    to_unpacked,
    to_vertical,
)

START = dt.date(2020, 1, 22)
H = "region string, country string, latitude float, longitude float, counts array<bigint>"


def test_dense_ordinal_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = dense_ordinal(df, "ord", order_by=["k"])
    ref = df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("ord"))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_dense_ordinal_file_order(spark):
    df = spark.range(0, 1000, numPartitions=5)
    got = dense_ordinal(df, "ord").collect()
    assert sorted((r.id, r.ord) for r in got) == [(i, i) for i in range(1000)]


def test_vertical_keeps_nulls_and_dates(spark):
    h = spark.createDataFrame([(None, "A", 1.0, 2.0, [1, None, 3]), ("R", "B", 0.0, 0.0, [])], H)
    v = to_vertical(h, ["region", "country", "latitude", "longitude"], START).collect()
    assert [(r.id, r.country, r.date, r.counts) for r in sorted(v, key=lambda r: r.date)] == [
        (0, "A", START, 1), (0, "A", START + dt.timedelta(1), None), (0, "A", START + dt.timedelta(2), 3)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 10**6)), min_size=1, max_size=6),
                min_size=1, max_size=5))
def test_round_trip_horizontal_vertical(spark, series):
    n = max(len(s) for s in series)
    rows = [(None, f"C{i}", 0.0, 0.0, s) for i, s in enumerate(series)]
    h = spark.createDataFrame(rows, H)
    v = to_vertical(h, ["region", "country", "latitude", "longitude"], START, id_col=None)
    back = to_horizontal(v, ["region", "country"], "counts", START, n)
    got = {r.country: r.counts for r in back.collect()}
    assert got == {f"C{i}": s + [None] * (n - len(s)) for i, s in enumerate(series)}


def test_to_horizontal_gap_stays_in_place(spark):
    v = spark.createDataFrame([("A", START, 1), ("A", START + dt.timedelta(2), 3)], "country string, date date, c bigint")
    got = to_horizontal(v, ["country"], "c", START).collect()
    assert got[0].counts == [1, None, 3]


def test_unpacked_width_and_names(spark):
    h = spark.createDataFrame([(None, "A", 1.0, 2.0, [1, 2])], H)
    u = to_unpacked(h, ["country"], "counts", START, 3)
    assert u.columns == ["country", "Jan 22 '20", "Jan 23 '20", "Jan 24 '20"]
    assert tuple(u.first()) == ("A", 1, 2, None)


def test_merge_global_outer_cases(spark):
    c = spark.createDataFrame([(None, "A", 1.0, 1.0, [1]), ("R1", "B", 2.0, 2.0, [2]), (None, "C", 3.0, 3.0, [3])], H)
    d = spark.createDataFrame([(None, "A", 1.0, 1.0, [10]), (None, "D", 4.0, 4.0, [40])], H)
    r = spark.createDataFrame([(None, "A", 1.0, 1.0, [100]), (None, "D", 4.0, 4.0, [400]), ("R1", "B", 2.0, 2.0, [200])], H)
    m = {(x.region, x.country): x for x in merge_global(c, d, r).collect()}
    assert set(m) == {(None, "A"), ("R1", "B"), (None, "C"), (None, "D")}
    assert (m[(None, "A")].confirmed, m[(None, "A")].deaths, m[(None, "A")].recovered) == ([1], [10], [100])
    # right-only row keeps its key and coordinates and still matches in the second join
    assert (m[(None, "D")].confirmed, m[(None, "D")].deaths, m[(None, "D")].recovered) == (None, [40], [400])
    assert m[(None, "D")].latitude == 4.0
    assert m[(None, "C")].deaths is None and m[("R1", "B")].recovered == [200]


def test_merge_us_population_from_deaths(spark):
    ids = ("uid bigint, iso2 string, iso3 string, code3 int, FIPS bigint, Admin2 string, region string, "
           "country string, latitude float, longitude float, combined_key string")
    c = spark.createDataFrame([(1, "U", "USA", 840, 1, "a", "S", "US", 1.0, 1.0, "k", [1])], ids + ", counts array<bigint>")
    d = spark.createDataFrame([(1, "U", "USA", 840, 1, "a", "S", "US", 1.0, 1.0, "k", [0], 500),
                               (2, "U", "USA", 840, 2, "b", "S", "US", 1.0, 1.0, "k2", [3], 7)],
                              ids + ", counts array<bigint>, population bigint")
    got = {r.uid: (r.confirmed, r.deaths, r.population) for r in merge_us(c, d).collect()}
    assert got == {1: ([1], [0], 500), 2: (None, [3], 7)}
    assert merge_us(c, d).columns[-3:] == ["confirmed", "deaths", "population"]


def test_growth_sum_equals_last_minus_first(spark):
    h = spark.createDataFrame([(None, "A", 0.0, 0.0, [3, 5, 5, 9, 20])], H)
    g = growth_horizontal(h, "counts").first().counts_growth
    assert g[0] is None and sum(g[1:]) == 20 - 3
    v = to_vertical(h, ["region", "country", "latitude", "longitude"], START)
    gv = growth_vertical(v, "counts", ["region", "country"]).orderBy("date").collect()
    assert [r.counts_growth for r in gv] == g


def test_dense_ordinal_with_hot_tied_key(spark):
    # a third of the rows share one sort key: ids must still be exactly 0..n-1
    df = spark.range(0, 3000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    ids = sorted(r.ord for r in dense_ordinal(df, "ord", order_by=["k"]).collect())
    assert ids == list(range(3000))
    # and rows with a smaller key always get smaller ids
    rows = dense_ordinal(df, "ord", order_by=["k"]).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.k, []).append(r.ord)
    keys = sorted(by_key)
    assert all(max(by_key[a]) < min(by_key[b]) for a, b in zip(keys, keys[1:]))


def test_dense_ordinal_within_groups(spark):
    df = spark.createDataFrame([(g, k) for g in (None, "a", "b") for k in range(50, 0, -7)], "g string, k int")
    got = dense_ordinal(df, "ord", order_by=["k"], within=["g"]).collect()
    for g in (None, "a", "b"):
        rows = sorted((r.k, r.ord) for r in got if r.g == g)
        assert [o for _, o in rows] == list(range(len(rows)))


def test_to_vertical_many_matches_single(spark):
    from cumulus.operators import to_vertical_many

    a = spark.createDataFrame([(None, "B", 0.0, 0.0, [1, 2]), ("R", "A", 0.0, 0.0, [3])], H)
    b = spark.createDataFrame([(None, "C", 0.0, 0.0, [5])], H)
    ids = ["region", "country", "latitude", "longitude"]
    many = to_vertical_many({"a": a, "b": b}, ids, START, id_order=["country", "region"])
    for k, f in (("a", a), ("b", b)):
        single = to_vertical(f, ids, START, id_order=["country", "region"])
        assert sorted(many[k].select(*single.columns).collect()) == sorted(single.collect())


def test_to_horizontal_duplicate_day_raises(spark):
    import pytest

    v = spark.createDataFrame([("A", START, 1), ("A", START, 2), ("A", START + dt.timedelta(1), 3)],
                              "country string, date date, c bigint")
    with pytest.raises(Exception):
        to_horizontal(v, ["country"], "c", START, 2).collect()


def test_to_horizontal_complete_and_truncated(spark):
    v = spark.createDataFrame([("A", START + dt.timedelta(i), i) for i in range(4)],
                              "country string, date date, c bigint")
    assert to_horizontal(v, ["country"], "c", START).first().counts == [0, 1, 2, 3]
    assert to_horizontal(v, ["country"], "c", START, 5).first().counts == [0, 1, 2, 3, None]


@pytest.mark.parametrize("start, n_days", [(START, 2), (START, 0), (START + dt.timedelta(1), None), (START + dt.timedelta(1), 9)])
def test_to_horizontal_drops_no_day(spark, start, n_days):
    v = spark.createDataFrame([("A", START + dt.timedelta(i), i) for i in range(4)],
                              "country string, date date, c bigint")
    with pytest.raises(Exception, match="lies outside"):
        to_horizontal(v, ["country"], "c", start, n_days).collect()


def test_to_unpacked_drops_no_day(spark):
    from cumulus.operators import to_unpacked

    h = spark.createDataFrame([("A", [1, 2, 3])], "country string, counts array<bigint>")
    with pytest.raises(Exception, match="longer than"):
        to_unpacked(h, ["country"], "counts", START, 2).collect()
    assert to_unpacked(h, ["country"], "counts", START, 4).first()[1:] == (1, 2, 3, None)


def test_merge_raises_on_a_repeated_key_and_filters_below(spark):
    from cumulus.operators import merge_global

    one = spark.createDataFrame([(None, "A", 1.0, 2.0, [1]), ("R", "B", 1.0, 2.0, [2])], H)
    twice = one.union(one)
    empty = one.limit(0)
    with pytest.raises(Exception, match="twice"):
        merge_global(one, twice, empty).collect()
    got = {(r.region, r.country): r for r in merge_global(empty, one, empty).collect()}
    assert got[None, "A"].latitude == 1.0 and got[None, "A"].deaths == [1] and got[None, "A"].confirmed is None
    plan = merge_global(one, one, one).where("region IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("isnull(region") and "FullOuter" not in plan


def test_ordinal_without_group_exchange(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(60)], "g int, k int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    from cumulus.operators import shapes
    limit, shapes.MAX_BROADCAST_ROWS = shapes.MAX_BROADCAST_ROWS, 0
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = dense_ordinal(df, "ord", order_by=["k"], within=["g"])
        assert sorted(out.collect()) == sorted((i % 3, i, i // 3) for i in range(60))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_pid" in plan[plan.index("hashpartitioning"):plan.index("hashpartitioning") + 60]
    finally:
        shapes.MAX_BROADCAST_ROWS = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_release_deletes_what_was_written(spark):
    import os

    from cumulus import session

    df = spark.createDataFrame([(1,)], "k int")
    with session.releasing(spark):
        path = session.materialize(df, "t").inputFiles()[0]
        assert os.path.exists(session.local_path(path))
    assert not os.path.exists(session.local_path(path))


def test_releasing_keeps_named_frames_and_other_threads(spark):
    import os
    from concurrent.futures import ThreadPoolExecutor

    from cumulus import session

    df = spark.createDataFrame([(1,)], "k int")
    there = lambda f: os.path.exists(session.local_path(f.inputFiles()[0]))
    with session.releasing(spark, this_thread=True) as kept:
        gone, stays = session.materialize(df, "gone"), session.materialize(df, "stays")
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(session.materialize, df, "other").result()
        kept.append(stays)
    assert [there(f) for f in (gone, stays, other)] == [False, True, True]
    with pytest.raises(ValueError), session.releasing(spark) as kept:
        failed = session.materialize(df, "failed")
        kept.append(failed)
        raise ValueError
    assert not there(failed)
    session.release_frames(spark, stays, other)
    assert not there(stays) and not there(other)
