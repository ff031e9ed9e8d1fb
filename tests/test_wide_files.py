"""Records with line breaks read by many tasks, releases of a wide file, wide export as text, one joined file."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from cumulus.operators import cleaning
from cumulus.sinks import join_parts, preview_rows, wide_lines, write_csv, write_wide_csv
from cumulus.sources import load_all, read_records, read_table_csv, read_wide_csv, read_wide_releases
from cumulus.sources.catalog import INPUT_FILES

START = dt.date(2020, 1, 22)


def write_text(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def multi_line_text(rng, n, header=True, end="\n"):
    cell = lambda: rng.choice(["plain", "", '"a, b"', '"said ""so"""', f'"two{end}lines"', f'"{end}"', f'"a{end}{end}""x"",{end}b"',
                               '"' + f"long {end}" * rng.randint(1, 400) + '"'])
    lines = ["id,one,two"] if header else []
    for i in range(n):
        lines.append(f"{i},{cell()},{cell()}")
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.5 else "")


@pytest.mark.parametrize("seed, end", [(0, "\n"), (1, "\n"), (2, "\r\n")])
def test_split_records_equal_the_unsplit_reader(spark, tmp_out, small_splits, seed, end):
    rng = random.Random(seed)
    for name in ("a.csv", "b.csv", "c.csv"):
        write_text(f"{tmp_out}/in/{name}", multi_line_text(rng, 150, end=end))
    whole = read_table_csv(spark, tmp_out + "/in", multi_line=True)
    split = read_table_csv(spark, tmp_out + "/in", multi_line="split")
    assert split.columns == whole.columns and rows_of(split) == rows_of(whole)
    ranges = spark.read.text(tmp_out + "/in").select(F.col("_metadata.file_block_start")).distinct().count()
    assert ranges > 5


def test_split_records_flags_headers_and_odd_files(spark, tmp_out, small_splits):
    write_text(f"{tmp_out}/in/a.csv", 'id,one,two\n1,"x\ny",z\n2,short\n3,"long\n",a,b\n')
    got = read_table_csv(spark, tmp_out + "/in", multi_line="split", flag_malformed=True)
    assert sorted((r.id, r._corrupt_record) for r in got.collect()) == [("1", None), ("2", "2,short"), ("3", '3,"long\n",a,b')]
    bare = read_table_csv(spark, tmp_out + "/in", header=False, multi_line="split")
    assert bare.count() == 4
    write_text(f"{tmp_out}/in/b.csv", "id,two,one\n4,a,b\n")
    with pytest.raises(Exception, match="header"):
        read_table_csv(spark, tmp_out + "/in", multi_line="split").collect()
    assert read_table_csv(spark, tmp_out + "/in", multi_line="split", check_headers=False).count() == 4
    # A header of several lines, a file of a header only, an empty file.
    write_text(f"{tmp_out}/odd/a.csv", '"first\nname",b\n1,2\n')
    write_text(f"{tmp_out}/odd/b.csv", '"first\nname",b\n')
    write_text(f"{tmp_out}/odd/c.csv", "")
    odd = read_table_csv(spark, tmp_out + "/odd", multi_line="split")
    assert odd.columns == ["first\nname", "b"] and rows_of(odd) == [("1", "2")]
    assert read_records(spark, tmp_out + "/odd").count() == 3


def test_wide_file_with_line_breaks(spark, tmp_out, small_splits):
    days = ",".join(f"1/{d}/20" for d in range(1, 31))
    body = "\n".join(f'"Province {i},\nnorth",C{i},1.0,2.0,' + ",".join(str(i + d) for d in range(30)) for i in range(200))
    write_text(f"{tmp_out}/w/a.csv", f"Province/State,Country/Region,Lat,Long,{days}\n{body}\n")
    split, whole = (cleaning.global_horizontal(read_wide_csv(spark, tmp_out + "/w", multi_line=m)) for m in ("split", True))
    assert rows_of(split) == rows_of(whole) and split.count() == 200
    vertical = cleaning.global_vertical(read_wide_csv(spark, tmp_out + "/w", multi_line="split"), id_order=["country"])
    assert vertical.count() == 6000 and vertical.select("id").distinct().count() == 200


HEAD = "Province/State,Country/Region,Lat,Long"


def test_releases_newest_value_wins(spark, tmp_out):
    write_text(f"{tmp_out}/r/2020-01.csv", f"{HEAD},1/22/20,1/23/20,1/24/20\n,A,1,2,1,2,3\nX,B,3,4,7,8,9\n,Old,5,6,1,1,1\n")
    write_text(f"{tmp_out}/r/2020-02.csv", "Country_Region,Province/State,Long,Lat,1/24/20,1/23/20,1/26/20\nA,,2,1,33,,5\nB,X,,,10,88,11\nNew,,7,8,0,0,1\n")
    wide = read_wide_releases(spark, tmp_out + "/r", keys=[0, 1], aliases={"Country_Region": "Country/Region"})
    assert wide.start_date == START and wide.n_days == 5 and wide.day_columns[-1] == "1/26/20"
    got = {r.country: (r.region, r.latitude, r.longitude, r.counts) for r in cleaning.global_horizontal(wide).collect()}
    assert got == {"A": (None, 1.0, 2.0, [1, 2, 33, None, 5]), "B": ("X", 3.0, 4.0, [7, 88, 10, None, 11]),
                   "Old": (None, 5.0, 6.0, [1, 1, 1, None, None]), "New": (None, 8.0, 7.0, [None, 0, 0, None, 1])}
    side_by_side = read_wide_releases(spark, tmp_out + "/r", aliases={"Country_Region": "Country/Region"})
    assert cleaning.global_horizontal(side_by_side).count() == 6
    assert cleaning.bad_series_rows(side_by_side).count() == 0
    days = cleaning.global_vertical(wide, id_order=["country"]).where("country = 'B'").orderBy("date").collect()
    assert [(r.date.day, r.counts) for r in days] == [(22, 7), (23, 88), (24, 10), (25, None), (26, 11)]
    # The same day columns in another file are the same layout, and a later path is newer.
    write_text(f"{tmp_out}/r/2020-03.csv", "Country_Region,Province/State,Long,Lat,1/24/20,1/23/20,1/26/20\nA,,2,1,34,,\n")
    again = read_wide_releases(spark, tmp_out + "/r", keys=[0, 1], aliases={"Country_Region": "Country/Region"})
    assert {r.country: r.counts for r in cleaning.global_horizontal(again).collect()}["A"] == [1, 2, 34, None, 5]
    write_text(f"{tmp_out}/r/2020-04.csv", f"{HEAD},1/22/20\n,A,1,2,1\n,A,1,2,4\n")
    with pytest.raises(Exception, match="twice"):
        read_wide_releases(spark, tmp_out + "/r", keys=[0, 1], aliases={"Country_Region": "Country/Region"}).df.collect()


def test_load_all_takes_releases(spark, tmp_out):
    us = "UID,iso2,iso3,code3,FIPS,Admin2,Province_State,Country_Region,Lat,Long_,Combined_Key"
    for m in ("confirmed", "deaths", "recovered"):
        folder = f"{tmp_out}/{INPUT_FILES[f'global_{m}']}"
        write_text(f"{folder}/old.csv", f"{HEAD},1/22/20\n,A,1,2,1\n")
        write_text(f"{folder}/new.csv", f"{HEAD},1/22/20,1/23/20\n,A,1,2,4,5\n,B,1,2,6,7\n")
    write_text(f"{tmp_out}/{INPUT_FILES['us_confirmed']}/a.csv", f"{us},1/22/20\n1,US,USA,840,1.0,a,S,US,1,2,k,3\n")
    write_text(f"{tmp_out}/{INPUT_FILES['us_deaths']}/a.csv", f"{us},Population,1/22/20\n1,US,USA,840,1.0,a,S,US,1,2,k,100,3\n")
    write_text(f"{tmp_out}/{INPUT_FILES['us_deaths']}/b.csv", f"{us},Population,1/23/20\n1,US,USA,840,1.0,a,S,US,1,2,k,101,4\n")
    write_text(f"{tmp_out}/{INPUT_FILES['places']}", f"{us},Population\n1,US,USA,840,1,a,S,US,1,2,k,100\n")
    write_text(f"{tmp_out}/{INPUT_FILES['observation_log']}", "SNo,a,b,c,d,e,f,g\n1,01/22/2020,,US,1/22/2020 17:00,1.0,0.0,0.0\n")
    frames = load_all(spark, tmp_out, releases=True)
    assert {r.country: r.counts for r in frames["global_confirmed"].collect()} == {"A": [4, 5], "B": [6, 7]}
    assert [(r.uid, r.population, r.counts) for r in frames["us_deaths"].collect()] == [(1, 101, [3, 4])]


def wide_series(spark, n_days, n=40):
    rows = [(None if i % 2 else f"R, {i}", f'C "{i}"', float(i), None, [i * d if d % 5 else None for d in range(n_days - i % 3)]) for i in range(n)]
    return spark.createDataFrame(rows + [(" blanks ", "two\nlines", None, 0.0, None), ("", "empty", 1.0, 2.0, [])],
                                 "region string, country string, latitude float, longitude float, counts array<bigint>")


IDS = ["region", "country", "latitude", "longitude"]


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("quote_all", [False, True])
def test_wide_export_of_many_days(spark, tmp_out, single, quote_all):
    df = wide_series(spark, 1500)
    write_wide_csv(df, tmp_out + "/w", IDS, "counts", START, quote_all=quote_all, single_file=single)
    wide = read_wide_csv(spark, tmp_out + "/w", multi_line=True)
    assert wide.n_days == 1500 and wide.start_date == START and (len(wide.df.inputFiles()) == 1 or not single)
    got = {r.country: r for r in cleaning.global_horizontal(wide).collect()}
    assert len(got) == 42 and got["two\nlines"].region == " blanks " and got["two\nlines"].counts == [None] * 1500
    for r in df.collect():
        assert got[r.country].counts == (r.counts or []) + [None] * (1500 - len(r.counts or []))
        assert got[r.country].region == (r.region or None) and got[r.country].latitude == (r.latitude or 0.0)


def test_wide_export_plan_does_not_grow_with_the_days(spark, tmp_out):
    df = wide_series(spark, 10)
    plans = [wide_lines(df, IDS, "counts", START, n)._jdf.queryExecution().analyzed().toString() for n in (30, 3000)]
    size = lambda p: len("".join(c for c in p if not c.isdigit()))
    assert size(plans[0]) == size(plans[1])
    with pytest.raises(Exception, match="longer than"):
        write_wide_csv(df, tmp_out + "/short", IDS, "counts", START, 9)


def test_wide_export_without_rows(spark, tmp_out):
    for name, single in (("a", False), ("b", True)):
        write_wide_csv(wide_series(spark, 3).limit(0), f"{tmp_out}/{name}", IDS, "counts", START, 2, single_file=single)
        wide = read_wide_csv(spark, f"{tmp_out}/{name}")
        assert wide.day_columns == ["1/22/20", "1/23/20"] and wide.df.count() == 0


def test_single_file_keeps_order_header_and_modes(spark, tmp_out):
    df = spark.range(0, 1000, numPartitions=7).select("id", F.when(F.col("id") % 5 == 0, 'a "b", c').otherwise(" x ").alias("t, \"u\""))
    path = tmp_out + "/one"
    write_csv(df, path, include_header=True, single_file=True)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 1 and not [f for f in os.listdir(path) if f.endswith(".crc") and "part" in f]
    with open(f"{path}/{files[0]}") as f:
        lines = f.read().splitlines()
    assert lines[0] == 'id,"t, ""u"""' and [ln.split(",")[0] for ln in lines[1:]] == [str(i) for i in range(1000)]
    assert rows_of(read_table_csv(spark, path)) == rows_of(df.select(F.col("id").cast("string"), "`t, \"u\"`"))
    with pytest.raises(FileExistsError):
        write_csv(df, path, single_file=True)
    write_csv(df.limit(3), path, single_file=True, mode="ignore")
    assert read_table_csv(spark, path).count() == 1000
    write_csv(df.limit(3), path, single_file=True, mode="overwrite")
    assert read_table_csv(spark, path, header=False).count() == 3
    with pytest.raises(ValueError):
        write_csv(df, path, single_file=True, mode="append")
    assert not [f for f in os.listdir(tmp_out) if f.startswith(".one")]
    write_csv(df.limit(0), tmp_out + "/none", include_header=True, single_file=True)
    assert read_table_csv(spark, tmp_out + "/none").columns == ["id", 't, "u"']


def test_single_file_is_written_by_many_tasks(spark, tmp_out):
    # The rows go to parts, a task for each partition; joining them reads none.
    df = spark.range(0, 900, numPartitions=9)
    df.write.csv(tmp_out + "/parts")
    assert len([f for f in os.listdir(tmp_out + "/parts") if f.startswith("part-")]) == 9
    join_parts(spark, tmp_out + "/parts")
    assert len([f for f in os.listdir(tmp_out + "/parts") if f.startswith("part-")]) == 1
    assert [int(r[0]) for r in read_table_csv(spark, tmp_out + "/parts", header=False).collect()] == list(range(900))


def test_preview_rows(spark):
    df = spark.createDataFrame([(1, "a text of more than twenty letters", None), (2, "short", 1.5)], "i int, `t.x` string, d double")
    assert [tuple(r) for r in preview_rows(df).collect()] == [("1", "a text of more th...", "NULL"), ("2", "short", "1.5")]
    assert [tuple(r) for r in preview_rows(df, 1, truncate=0).collect()] == [("1", "a text of more than twenty letters", "NULL")]
    assert preview_rows(df, 1, truncate=3).first()[1] == "a t"
    assert preview_rows(df.limit(0)).count() == 0
