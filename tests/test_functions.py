import datetime as dt

from pyspark.sql import functions as F

from cumulus.functions import (
    array_text,
    coordinate,
    day_value,
    float_text_long,
    measure_long,
    normalise_country,
    normalise_region,
    observed_date,
    pairwise_growth,
    quarter_index,
    split_quoted,
    try_long,
    update_date,
)
from cumulus.functions.dates import day_label, header_day_name, parse_header_day

D = dt.date


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_update_date_all_layouts(spark):
    vals = ["1/22/2020 17:00", "1/22/20 17:00", "1/22/20 7:00", "2020-02-01T19:53:03",
            "2020-03-08 05:31:00", "Jan 22", "1/22/20 0:30", None, "", "5/7/96 3:00", "13/45/2020 1:00"]
    got = one(spark, [(v,) for v in vals], "v string", update_date("v"))
    assert got == [D(2020, 1, 22), D(2020, 1, 22), D(2020, 1, 22), D(2020, 2, 1), D(2020, 3, 8),
                   None, D(2020, 1, 22), None, None, D(2096, 5, 7), None]


def test_observed_date_strict(spark):
    got = one(spark, [("01/22/2020",), ("1/2/2020",), (None,)], "v string", observed_date("v"))
    assert got == [D(2020, 1, 22), None, None]


def test_number_parsing(spark):
    vals = ["12", "12.0", " 7 ", "1.5", "abc", None, "", "1001.0", "-3"]
    rows = [(v,) for v in vals]
    assert one(spark, rows, "v string", try_long("v")) == [12, None, 7, None, None, None, None, None, -3]
    assert one(spark, rows, "v string", measure_long("v")) == [12, 12, 7, 1, None, None, None, 1001, -3]
    assert one(spark, rows, "v string", float_text_long("v")) == [12, 12, 7, 1, None, None, None, 1001, -3]


def test_coordinate_defaults_to_zero(spark):
    got = one(spark, [("36.0",), (None,), ("x",), ("-86.6",)], "v string", coordinate("v"))
    assert got[:3] == [36.0, 0.0, None] and abs(got[3] + 86.6) < 1e-5


def test_normalise_region(spark):
    rows = [("Diamond Princess cruise ship", "Canada"), ("Grand Princess", "US"), ("None", "X"),
            ("Unknown county", "X"), ("France", "France"), (" Hubei ", "China"), (None, "X")]
    got = one(spark, rows, "r string, c string", normalise_region("r", "c"))
    assert got == ["Diamond Princess", "Grand Princess", None, None, None, "Hubei", None]


def test_normalise_country(spark):
    rows = [("('St. Martin',)",), ("Bahamas, The",), ("The Gambia",), ("  Spain ",), (None,)]
    assert one(spark, rows, "c string", normalise_country("c")) == ["St. Martin", "Bahamas", "Gambia", "Spain", None]


def test_split_quoted(spark):
    rows = [(',"Korea, South",36.0,128.0,1,2',), ('"x ""y"" z",B,2,3,5,6',), (",A,2.0,3.0,4,",)]
    got = one(spark, rows, "l string", split_quoted("l"))
    assert got[0] == [None, "Korea, South", "36.0", "128.0", "1", "2"]
    assert got[1] == ["x y z", "B", "2", "3", "5", "6"]
    assert got[2] == [None, "A", "2.0", "3.0", "4", None]


def test_pairwise_growth_null_tolerant(spark):
    rows = [([1, 3, 6],), ([1, None, 6],), ([],), (None,), ([5],)]
    got = one(spark, rows, "a array<bigint>", pairwise_growth("a"))
    assert got == [[None, 2, 3], [None, None, None], [], None, [None]]


def test_day_value_past_end_is_null(spark):
    got = one(spark, [([1, 2, 3],)], "a array<bigint>", F.array(day_value("a", 3), day_value("a", 4)))
    assert got == [[3, None]]


def test_array_text(spark):
    assert one(spark, [([1, None, 3],)], "a array<bigint>", array_text("a")) == ["1,null,3"]


def test_quarter_index(spark):
    rows = [(D(2020, 1, 1),), (D(2020, 12, 31),), (D(2021, 5, 1),)]
    assert one(spark, rows, "d date", quarter_index("d")) == [1, 4, 6]


def test_labels():
    assert day_label(D(2020, 1, 22), 0) == "Jan 22 '20"
    assert header_day_name(D(2020, 1, 22)) == "1/22/20"
    assert parse_header_day("1/22/20") == D(2020, 1, 22)
    assert parse_header_day("Lat") is None


def _plain_split(line):
    """Commas outside quotes split; quotes go; empty is null; an odd number of quotes has no fields."""
    if line.count('"') % 2:
        return None
    fields, field, inside = [], "", False
    for ch in line:
        if ch == '"':
            inside = not inside
        elif ch == "," and not inside:
            fields.append(field or None)
            field = ""
        else:
            field += ch
    return [*fields, field or None]


def test_split_quoted_against_plain_splitter(spark):
    import random

    from cumulus.functions import split_quoted

    rng = random.Random(5)
    lines = ["".join(rng.choice('ab ,"') for _ in range(rng.randrange(25))) for _ in range(3000)]
    lines += [' "Korea, South",1,2', 'abc "x, y",3', '"a"b"c,d",e', '"' + "x," * 50_000 + '",1', "a" * 100_000 + ',"' + '""' * 5_000 + '"']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r.i: r.t for r in df.select("i", split_quoted("line").alias("t")).collect()}
    for i, line in enumerate(lines):
        assert got[i] == _plain_split(line), line[:80]


def test_region_equal_to_the_repaired_country(spark):
    from cumulus.functions import normalise_region

    df = spark.createDataFrame([("Bahamas", "Bahamas, The"), ("Hubei", "China"), ("X", "X")], "region string, country string")
    assert [r[0] for r in df.select(normalise_region("region", "country")).collect()] == [None, "Hubei", None]


def test_two_digit_years_and_garbage(spark):
    from cumulus.functions import update_date
    from cumulus.functions.dates import parse_header_day
    from cumulus.functions.parse import code_or_zero, coordinate

    df = spark.createDataFrame([("1/2/96 3:04",)], "t string")
    assert [str(x) for x in df.select(update_date("t"), update_date("t", pivot=69)).first()] == ["2096-01-02", "1996-01-02"]
    assert parse_header_day("1/2/96").year == 2096 and parse_header_day("1/2/96", pivot=69).year == 1996
    df = spark.createDataFrame([(None,), ("abc",), ("7.0",)], "t string")
    assert [tuple(r) for r in df.select(coordinate("t"), code_or_zero("t")).collect()] == [(0.0, 0), (None, None), (7.0, 7)]
