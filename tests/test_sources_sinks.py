import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cumulus.operators import cleaning
from cumulus.sinks import write_csv, write_wide_csv
from cumulus.sources import bad_lines, read_lines, read_table_csv, read_wide_csv, tokenised_lines

START = dt.date(2020, 1, 22)


def write_text(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


GLOBAL = ('Province/State,Country/Region,Lat,Long,1/22/20,1/23/20,1/24/20\n'
          ',"Korea, South",36.0,128.0,1,2,3\n'
          '"x ""y"" z",B,2,3,5,6,7\n'
          ',A,2.0,3.0,4,5,\n'
          ',Ship,,,1,1,1\n')


def test_read_wide_csv_header_driven(spark, tmp_out):
    write_text(tmp_out + "/g", "a.csv", GLOBAL)
    write_text(tmp_out + "/g", "b.csv", GLOBAL.splitlines()[0] + "\n,Late,1,1,9,9,9\n")
    wide = read_wide_csv(spark, tmp_out + "/g")
    assert wide.start_date == START and wide.n_days == 3
    h = {r.country: r for r in cleaning.global_horizontal(wide).collect()}
    assert set(h) == {"Korea, South", "B", "A", "Ship", "Late"}  # header dropped in every file
    assert h["A"].counts == [4, 5, None] and (h["Ship"].latitude, h["Ship"].longitude) == (0.0, 0.0)
    assert h["B"].region == 'x "y" z'
    v = cleaning.global_vertical(wide, id_order=["country"]).where(F.col("country") == "A").orderBy("date").collect()
    assert [(r.date, r.counts) for r in v] == [(START, 4), (START + dt.timedelta(1), 5), (START + dt.timedelta(2), None)]


def test_non_consecutive_days_rejected(spark, tmp_out):
    write_text(tmp_out + "/bad", "a.csv", "a,b,c,d,1/22/20,1/24/20\n,A,1,1,1,2\n")
    with pytest.raises(ValueError):
        read_wide_csv(spark, tmp_out + "/bad")


def test_raw_lines_tokeniser(spark, tmp_out):
    write_text(tmp_out + "/t", "a.csv", GLOBAL)
    # a second file whose header differs: its first line must still be dropped
    write_text(tmp_out + "/t", "b.csv", "other,header\n,Late,1,1,9,9,9\n")
    toks = [r.tokens for r in tokenised_lines(read_lines(spark, tmp_out + "/t")).collect()]
    assert len(toks) == 5 and [None, "Korea, South", "36.0", "128.0", "1", "2", "3"] in toks
    assert not any(t[0] in ("Province/State", "other") for t in toks)


def test_header_check(spark, tmp_out):
    write_text(tmp_out + "/h", "a.csv", GLOBAL)
    write_text(tmp_out + "/h", "b.csv", GLOBAL.splitlines()[0] + "\n,Late,1,1,9,9,9\n")
    assert read_wide_csv(spark, tmp_out + "/h").df.count() > 0
    # a later release with other day columns fails while it is read, instead of being mapped by position
    write_text(tmp_out + "/h", "c.csv", GLOBAL.splitlines()[0] + ",1/25/20\n,X,1,1,1,1,1,1\n")
    with pytest.raises(Exception, match="header|Header"):
        cleaning.global_horizontal(read_wide_csv(spark, tmp_out + "/h")).collect()


def test_bad_rows_are_reported(spark, tmp_out):
    head = GLOBAL.splitlines()[0]
    write_text(tmp_out + "/b", "a.csv", head + "\n,Good,,1,1,2,3\n,Lat,x,1,1,2,3\n,Count,1,1,1,2,z\n,Long,1,1,1,2,3,4\n,Short,1,1,1,2\n")
    wide = read_wide_csv(spark, tmp_out + "/b", flag_malformed=True)
    bad = {r[1] for r in cleaning.bad_series_rows(wide).collect()}
    assert bad == {"Lat", "Count", "Long", "Short"}
    rows = {r.country: r for r in cleaning.global_horizontal(wide).collect()}
    assert rows["Good"].latitude == 0.0 and rows["Lat"].latitude is None
    us = US_DEATHS.replace("84001003,US,USA,,", "84001003,US,USA,code,")
    write_text(tmp_out + "/u", "a.csv", us)
    wide = read_wide_csv(spark, tmp_out + "/u", flag_malformed=True)
    assert [r[0] for r in cleaning.bad_series_rows(wide, us=True).collect()] == ["84001003"]
    places = read_table_csv(spark, tmp_out + "/u", flag_malformed=True)
    assert cleaning.bad_place_rows(places).count() == 1


def test_raw_lines_drop_each_files_first_line(spark, tmp_out):
    from cumulus.sources import bad_lines

    write_text(tmp_out + "/raw", "a.csv", 'h,"1"\na,"b,c"\n\n  x , y \n"open,1\n')
    write_text(tmp_out + "/raw", "b.csv", "other\nh,1\n")
    lines = read_lines(spark, tmp_out + "/raw")
    assert sorted(r.value for r in lines.collect()) == ["  x , y ", '"open,1', 'a,"b,c"', "h,1"]
    assert [r.value for r in bad_lines(lines).collect()] == ['"open,1']
    assert "Join" not in lines._jdf.queryExecution().executedPlan().toString()
    assert read_lines(spark, tmp_out + "/raw", drop_header=False).count() == 6


US_DEATHS = ("UID,iso2,iso3,code3,FIPS,Admin2,Province_State,Country_Region,Lat,Long_,Combined_Key,Population,1/22/20,1/23/20\n"
             '84001001,US,USA,840,1001.0,Autauga,Alabama,US,32.5,-86.6,"Autauga, Alabama, US",55869,0,1\n'
             '84001003,US,USA,,,Baldwin,Alabama,US,,,"Baldwin, Alabama, US",,2,\n')


def test_us_file_with_population(spark, tmp_out):
    write_text(tmp_out + "/us", "a.csv", US_DEATHS)
    wide = read_wide_csv(spark, tmp_out + "/us")
    h = {r.uid: r for r in cleaning.us_horizontal(wide, with_population=True).collect()}
    assert h[84001001].FIPS == 1001 and h[84001001].population == 55869 and h[84001001].counts == [0, 1]
    assert (h[84001003].code3, h[84001003].FIPS, h[84001003].population, h[84001003].counts) == (0, 0, None, [2, None])
    v = cleaning.us_vertical(wide, with_population=True).where(F.col("uid") == 84001001).orderBy("date").collect()
    # first day keeps its date, population from its own column
    assert [(r.date, r.counts, r.population) for r in v] == [(START, 0, 55869), (START + dt.timedelta(1), 1, 55869)]


LOG = ("SNo,ObservationDate,Province/State,Country/Region,Last Update,Confirmed,Deaths,Recovered\n"
       "1,01/22/2020,Diamond Princess cruise ship,Others,1/22/2020 17:00,12.0,1.0,0.0\n"
       "2,01/22/2020,None,\"('St. Martin',)\",1/22/20 17:00,12,0,0\n"
       '3,01/23/2020,Unknown,"Bahamas, The",1/22/20 7:00,3.0,,1.0\n'
       "4,1/23/2020,Hubei,China,Jan 22,1.0,x,0.0\n")


def test_observation_log_cleaning_and_bad_rows(spark, tmp_out):
    write_text(tmp_out + "/log", "a.csv", LOG)
    raw = read_table_csv(spark, tmp_out + "/log")
    got = {r.id: r for r in cleaning.observation_log(raw).collect()}
    assert (got[1].region, got[1].country, got[1].confirmed) == ("Diamond Princess", "Others", 12)
    assert (got[2].region, got[2].country, got[2].confirmed) == (None, "St. Martin", 12)
    assert (got[3].region, got[3].country, got[3].deaths, got[3].last_updated) == (None, "Bahamas", None, dt.date(2020, 1, 22))
    assert (got[4].observed_date, got[4].last_updated, got[4].deaths) == (None, None, None)
    assert [r[0] for r in cleaning.bad_log_rows(raw).collect()] == ["4"]


def test_csv_sink_round_trip_and_existing_path(spark, tmp_out):
    df = spark.createDataFrame([(1, "a, b", None), (2, 'q"q', 2.5)], "id bigint, s string, x double")
    write_csv(df, tmp_out + "/out", include_header=True)
    back = read_table_csv(spark, tmp_out + "/out")
    assert sorted((int(r.id), r.s, r.x) for r in back.collect()) == [(1, "a, b", None), (2, 'q"q', "2.5")]
    with pytest.raises(Exception):
        write_csv(df, tmp_out + "/out")


def test_wide_sink_then_source(spark, tmp_out):
    h = spark.createDataFrame([(None, "A", 1.0, 2.0, [1, None, 3])],
                              "region string, country string, latitude float, longitude float, counts array<bigint>")
    write_wide_csv(h, tmp_out + "/w", ["region", "country", "latitude", "longitude"], "counts", START, 3)
    wide = read_wide_csv(spark, tmp_out + "/w")
    assert wide.start_date == START and cleaning.global_horizontal(wide).first().counts == [1, None, 3]


def test_load_all_and_views(spark, tmp_out):
    from cumulus.sources import INPUT_FILES, load_all, register_views

    folder = tmp_out + "/data"
    places = ("UID,iso2,iso3,code3,FIPS,Admin2,Province_State,Country_Region,Lat,Long_,Combined_Key,Population\n"
              "410,KR,KOR,410,,,,\"Korea, South\",36.0,128.0,\"Korea, South\",51269183\n")
    write_text(folder, INPUT_FILES["places"], places)
    for m in ("confirmed", "deaths", "recovered"):
        write_text(folder, INPUT_FILES[f"global_{m}"], GLOBAL)
    us_conf = US_DEATHS.replace("Population,", "").replace(",55869,", ",").replace(",,2,", ",2,")
    write_text(folder, INPUT_FILES["us_confirmed"], us_conf)
    write_text(folder, INPUT_FILES["us_deaths"], US_DEATHS)
    write_text(folder, INPUT_FILES["observation_log"], LOG)
    frames = load_all(spark, folder, check_headers=True)
    assert frames["global_deaths"].count() == 4 and frames["us_deaths"].where("population = 55869").count() == 1
    assert frames["us_confirmed"].where("uid = 84001001").first().counts == [0, 1]
    from cumulus.plans.menu import menu_query, series_start

    start = series_start(spark, folder)
    assert start == START
    for n in range(1, 10):
        opts = {"day_index": 3} if n in (4, 5) else {}
        menu_query(n, frames, start, **opts).collect()
    assert menu_query(1, frames, start).columns[3:] == ["Jan 22 '20", "Jan 23 '20", "Jan 24 '20"]
    register_views(frames)
    got = spark.sql("SELECT g.country, element_at(g.counts, 3) / u.population AS incidence "
                    "FROM global_confirmed g JOIN places u ON g.country = u.country").collect()
    assert [(r.country, r.incidence) for r in got] == [("Korea, South", 3 / 51269183)]


def test_malformed_rows_flagged(spark, tmp_out, capsys):
    from cumulus.sinks import preview
    from cumulus.sources import malformed_rows

    write_text(tmp_out + "/m", "a.csv", "a,b,c,d,1/22/20,1/23/20\n,A,1,1,1,2\n,B,1,1,1\n,C,1,1,1,2,3\n")
    bad = sorted(r["_corrupt_record"] for r in malformed_rows(spark, tmp_out + "/m").collect())
    assert bad == [",B,1,1,1", ",C,1,1,1,2,3"]
    preview(read_table_csv(spark, tmp_out + "/m"), 2)
    assert "A" in capsys.readouterr().out


def test_headerless_dates_need_start(spark, tmp_out):
    write_text(tmp_out + "/nd", "a.csv", "r,c,lat,lon,d0,d1\n,A,1,2,5,6\n")
    wide = read_wide_csv(spark, tmp_out + "/nd", n_ids=4, start_date=START)
    assert wide.day_columns == ["d0", "d1"] and wide.start_date == START
    v = cleaning.global_vertical(wide).orderBy("date").collect()
    assert [(r.date, r.counts) for r in v] == [(START, 5), (START + dt.timedelta(1), 6)]


def test_materialize_under_checkpoint_dir(spark):
    from cumulus.session import ensure_checkpoint_dir, local_path, materialize

    df = materialize(spark.range(5), "unit")
    files = [local_path(f) for f in df.inputFiles()]
    base = local_path(ensure_checkpoint_dir(spark))
    assert files and all(f.startswith(base + "/") for f in files) and df.count() == 5


def test_layout_mismatch_rejected(spark, tmp_out):
    us_conf = US_DEATHS.replace("Population,", "").replace(",55869,", ",").replace(",,2,", ",2,")
    write_text(tmp_out + "/usc", "a.csv", us_conf)
    wide = read_wide_csv(spark, tmp_out + "/usc")
    with pytest.raises(ValueError):
        cleaning.us_horizontal(wide, with_population=True)  # no population column in this file
    assert cleaning.us_horizontal(wide).count() == 2


def test_multi_line_fields(spark, tmp_out):
    write_text(tmp_out + "/ml", "a.csv", 'a,b,c,d,1/22/20\n"two\nlines",A,1,1,5\n,B,1,1,6\n')
    wide = read_wide_csv(spark, tmp_out + "/ml", multi_line=True)
    got = {r.country: (r.region, r.counts) for r in cleaning.global_horizontal(wide).collect()}
    assert got == {"A": ("two\nlines", [5]), "B": (None, [6])}


def test_raw_lines_with_the_separator_stay_whole(spark, tmp_out):
    import os

    os.mkdir(tmp_out + "/sep")
    lines = ["a,b\x01c,\"d", "x,y", "\x01e,f\x01", "\"g,h\"\x01,i"]
    for i in range(2):
        with open(f"{tmp_out}/sep/{i}.csv", "w", newline="") as f:
            f.write("\n".join(["head\x01er", *lines, "", f"last{i}"]))
    got = read_lines(spark, tmp_out + "/sep")
    assert sorted(r.value for r in got.collect()) == sorted([*lines, *lines, "last0", "last1"])
    assert got.count() == 10
    assert [r.value for r in bad_lines(got).collect()] == [lines[0]] * 2
    assert sorted(r.tokens for r in tokenised_lines(got).collect() if r.tokens and len(r.tokens) == 2 and "g" in r.tokens[0]) == [["g,h\x01", "i"]] * 2
    assert read_lines(spark, tmp_out + "/sep", drop_header=False).where("value = 'head\x01er'").count() == 2
