"""Co-partitioned storage, file-order numbers, growth on hot keys: plans and results."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from cumulus import session
from cumulus.operators import dense_ordinal, file_ordinal, growth_vertical, growth_vertical_spread, merge_global, merge_us_vertical
from cumulus.session import materialize_by_key, release

H = "region string, country string, latitude float, longitude float, counts array<bigint>"
START = dt.date(2020, 1, 22)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def series(spark, n, shift=0, skip=0):
    rows = [(None if i % 3 else f"R{i}", f"C{i}", float(i), None, [i + shift, None, i * 2]) for i in range(n) if not skip or i % skip]
    return spark.createDataFrame(rows, H)


def test_merges_of_arrays_sort_nothing(spark):
    a, b, c = series(spark, 400), series(spark, 390, 5, skip=7), series(spark, 410, 9, skip=3)
    merged = merge_global(a, b, c)
    assert "SortAggregate" not in final_plan(merged) and "Sort " not in final_plan(merged)
    got = {(r.region, r.country): (r.latitude, r.confirmed, r.deaths, r.recovered) for r in merged.collect()}
    want = collections.defaultdict(lambda: [None] * 4)
    for i, f in enumerate((a, b, c)):
        for r in f.collect():
            row = want[r.region, r.country]
            row[0] = r.latitude if row[0] is None else row[0]
            row[i + 1] = r.counts
    assert got == {k: tuple(v) for k, v in want.items()}


@pytest.mark.parametrize("key", ["merge_global", "merge_us", "global_count_unpacked", "growth_unpacked", "growth_horizontal", "merge_global_vertical",
                                 "merge_us_vertical", "growth_vertical", "growth_vertical_us", "global_count_vertical", "us_count_vertical"])
def test_prepared_series_meet_without_exchange(spark, key):
    plan = final_plan(entry.queries()[key](spark, SF_SMALL))
    assert "Exchange" not in plan and "SortAggregate" not in plan


def test_stored_by_key_keeps_rows_names_and_nulls(spark):
    df = spark.createDataFrame([(None, "a b", 1, 2.0), ("x", None, 2, None), (None, None, 3, 1.5), ("x", "y", 4, 0.0)], "k string, `o.dd` string, n int, v double")
    held = materialize_by_key(df, "kept-by-key", ["k", "o.dd"], sort=["n"], buckets=3)
    assert held.columns == df.columns and sorted(map(str, held.collect())) == sorted(map(str, df.collect()))
    empty = materialize_by_key(df.limit(0), "kept-empty", ["k"])
    assert empty.count() == 0 and empty.columns == df.columns
    table = next(t.name for t in spark.catalog.listTables("spark_catalog.default") if t.name.startswith("cumulus_kept_by_key"))
    folder = held.inputFiles()[0].rpartition("/")[0]
    release(spark, [p for p in session._HELD if folder.endswith(p.rpartition("/")[2])])
    assert not spark.catalog.tableExists(f"spark_catalog.default.{table}")


def test_merge_of_stored_and_plain_files(spark):
    a, b = series(spark, 60), series(spark, 50, 5)
    held = materialize_by_key(a, "merge-held", ["region", "country"])
    assert sorted(map(str, merge_global(held, b, b).collect())) == sorted(map(str, merge_global(a, b, b).collect()))
    with pytest.raises(Exception, match="twice"):
        merge_global(held.union(held), b, b).collect()


def test_vertical_merge_with_text_identity(spark):
    ids = ("uid bigint, iso2 string, iso3 string, code3 int, FIPS bigint, Admin2 string, region string, "
           "country string, latitude float, longitude float, combined_key string, date date, counts bigint")
    row = lambda u, d, n, iso=None: (u, iso, "USA", 840, u, "a", "S", "US", 1.0, 2.0, "k", START + dt.timedelta(d), n)
    c = spark.createDataFrame([row(1, 0, 5, "U1"), row(1, 1, 6), row(2, 0, 7)], ids)
    d = spark.createDataFrame([(*row(1, 0, 1, "other"), 100), (*row(1, 1, 2, "U2"), 100), (*row(3, 0, 3), None)], ids + ", population bigint")
    got = {(r.uid, r.date.day): (r.iso2, r.confirmed, r.deaths, r.population) for r in merge_us_vertical(c, d).collect()}
    assert got == {(1, 22): ("U1", 5, 1, 100), (1, 23): ("U2", 6, 2, 100), (2, 22): (None, 7, None, None), (3, 22): (None, None, 3, None)}


@pytest.mark.parametrize("rows", [7, 64, 100_000])
def test_growth_on_a_hot_key(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i // 3, rng.choice([None, i, -i]), "x") for i in range(3000)]
    df = spark.createDataFrame(data, "k string, day int, v bigint, _carried string").withColumn("n", F.monotonically_increasing_id())
    got = growth_vertical_spread(df, "v", "k", ["day", "n"], window_rows=rows)
    want = df.withColumn("v_growth", F.col("v") - F.lag("v").over(Window.partitionBy("k").orderBy("day", "n")))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_growth_tasks_of_a_hot_key_are_even(spark):
    # A key with all but a few of the rows; no task has more than twice the median.
    df = spark.range(0, 160_000, numPartitions=8).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("day"), "id")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spread = growth_vertical_spread(df, "id", "k", "day", window_rows=200)
        sizes = sorted(r["count"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("id_growth")).collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plain = growth_vertical(df, "id", "k", "day").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("id_growth")).collect()
        assert max(r["count"] for r in plain) > 150_000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_file_ordinal(spark, tmp_out, fmt):
    spark.range(0, 30_000, numPartitions=4).select("id", F.repeat(F.lit("x"), 20).alias("pad")).write.format(fmt).save(tmp_out + "/t")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
        scan = spark.read.format(fmt).schema("id long, pad string").load(tmp_out + "/t")
        got = file_ordinal(scan, "n")
        assert got.columns == ["id", "pad", "n"]
        assert got.where("n <> id").count() == 0 and got.count() == 30_000
        assert "Exchange hash" not in final_plan(got) and "Sort" not in final_plan(got)
        assert file_ordinal(scan.where("id % 3 = 1").select("id"), "n").where("n <> id div 3").count() == 0
        in_file = file_ordinal(scan, "n", within_file=True)
        assert in_file.agg(F.max("n"), F.count_if(F.col("n") == 0)).first()[:] == (7499, 4)
        # A read of other splits than those counted is refused.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        if fmt != "parquet":
            again = file_ordinal(spark.read.format(fmt).schema("id long, pad string").load(tmp_out + "/t"), "n")
            assert again.where("n <> id").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_file_ordinal_needs_a_scan(spark, tmp_out):
    spark.range(10).write.parquet(tmp_out + "/t")
    scan = spark.read.parquet(tmp_out + "/t")
    for other in (spark.range(3), scan.orderBy("id"), scan.union(scan), scan.limit(3)):
        with pytest.raises(ValueError):
            file_ordinal(other)
    assert file_ordinal(scan.where("id > 100")).count() == 0
    assert sorted(dense_ordinal(scan.orderBy("id"), "n").collect()) == [(i, i) for i in range(10)]
