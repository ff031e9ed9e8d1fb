"""CSV sources.

Wide series files have a few identifying columns followed by one column per day,
headed by the day ("1/22/20"). They are read with Spark's CSV reader -- header
dropped in every file, RFC-4180 quotes (a comma inside quotes is data, ``""`` is
an escaped quote), every field as text -- and the header tells which columns are
days and which date the first one is. Column pruning and splitting across
files are the reader's own; nothing is collected except the header line.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cumulus.functions.dates import header_day_name, parse_header_day
from cumulus.functions.text import balanced_quotes, split_quoted
from cumulus.operators.shapes import MAX_BROADCAST_ROWS
from cumulus.session import materialize


CORRUPT_COLUMN = "_corrupt_record"


def _reader(spark: SparkSession, header: bool = True, multi_line: bool = False):
    return (
        spark.read.option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("inferSchema", False)
        .option("multiLine", multi_line)
    )


def read_table_csv(spark: SparkSession, path, header: bool = True, multi_line: bool | str = False,
                   check_headers: bool = True, flag_malformed: bool = False) -> DataFrame:
    """A comma-separated file (or folder of files) as text columns, header dropped in every file.

    Columns are named by the first file's header. Spark compares every file's own
    header with it while reading and fails on a difference (no extra scan), unless
    ``check_headers`` is off: files are then mapped by position. ``flag_malformed`` appends
    ``_corrupt_record``, the raw line of a row with too few or too many fields (null
    for the others); without it Spark pads or cuts such rows, and :func:`malformed_rows`
    gives them. ``multi_line`` allows line breaks inside quoted fields; Spark cannot split such
    files, so each is read by one task. ``multi_line="split"`` reads them in many (see :func:`read_records`).
    """
    first = _reader(spark, header, bool(multi_line)).csv(path)
    schema = StructType([StructField(c, StringType(), True) for c in first.columns]
                        + ([StructField(CORRUPT_COLUMN, StringType(), True)] if flag_malformed else []))
    if multi_line == "split":
        return _parsed_records(read_records(spark, path), schema, first.columns, header, check_headers)
    return (_reader(spark, header, multi_line).schema(schema)
            .option("enforceSchema", not (header and check_headers))
            .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
            # The parser counts a row's fields only when it reads all of them.
            .option("columnPruning", not flag_malformed).csv(path))


def read_records(spark: SparkSession, path) -> DataFrame:
    """ACTION (one pass that counts quotes): the records of comma-separated files as raw text, split where a
    line ends outside quotes, with ``first`` for the first record of a file.

    Files are read in Spark's own byte ranges, so one large file is read by many tasks. Whether a
    range starts inside a quoted field is decided by the lines with an odd number of quotes before
    it: they are counted per range, and a running sum over the ranges of a file carries the count on. A range without
    such a line is passed on as it is; in the others the lines are counted in order. Only
    records of several lines are put together, across ranges too. Quotes must be balanced, as in
    RFC 4180. Blank lines outside quotes hold no record. In a file whose first line ends in CR LF that is the
    line end, and inside fields it becomes LF, as Spark's reader does.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    toggles = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2 == 1
    placed = lines.select(
        "value", toggles.alias("_odd"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"), F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_at"))
    keys = ["_file", "_start", "_length", "_pid"]
    counts = placed.groupBy(*keys).agg(F.count_if("_odd").alias("_n"), F.min("_at").alias("_from"),
                                       F.min_by(F.col("value").endswith("\r"), "_at").alias("_cr"))
    in_file = Window.partitionBy("_file").orderBy("_start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # One row per range of the input, whatever its rows.
    ranges = materialize(counts.select(*keys, "_n", "_from", F.first("_cr").over(in_file).alias("_cr"),
                                       F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "csv-ranges")
    known = placed.join(F.broadcast(ranges) if ranges.count() <= MAX_BROADCAST_ROWS else ranges, keys, "left")
    moved = F.raise_error(F.lit("the files were split otherwise when their quotes were counted")).cast("long")
    known = known.withColumns({
        "_before": F.coalesce("_before", moved), "first": (F.col("_start") == 0) & (F.col("_at") == F.col("_from")),
        "value": F.when(F.col("_cr") & F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))})
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counted = known.where("_n > 0").withColumn(
        "_before", F.col("_before") + F.coalesce(F.count_if("_odd").over(inside), F.lit(0)))
    every = known.where("_n = 0").unionByName(counted)
    # After an odd count of odd lines a line lies inside a field; an odd line after an even count opens one.
    record = F.when(F.col("_before") % 2 == 1, F.col("_before")).when(F.col("_odd"), F.col("_before") + 1)
    tied = every.withColumn("_record", record)
    whole = tied.where("_record IS NULL").select("value", "first")
    joined = tied.where("_record IS NOT NULL").groupBy("_file", "_record").agg(
        F.sort_array(F.collect_list(F.struct("_start", "_at", "value"))).alias("_lines"), F.max("first").alias("first")).select(
        F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"), "first")
    return whole.unionByName(joined).where(F.col("value") != "")


def _parsed_records(records: DataFrame, schema: StructType, names: list[str], header: bool, check_headers: bool) -> DataFrame:
    """Records as text columns by Spark's own CSV parser; the first record of each file compared with ``names`` and dropped."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN, "lineSep": "\u0001"}
    parsed = records.withColumn("_row", F.from_csv("value", _ddl(schema), options))
    if header:
        other = F.raise_error(F.lit("a file's header is not the first file's")).cast("boolean")
        same = F.lit(True)
        if check_headers:
            fields = F.array(*[F.col(f"_row.`{n}`") for n in names])
            same = fields.eqNullSafe(F.array(*[F.lit(n) for n in names]))
        parsed = parsed.where(F.when(F.col("first"), F.when(same, False).otherwise(other)).otherwise(True))
    return parsed.select("_row.*")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


@dataclass
class WideFile:
    """A wide series file: raw text columns, which are identifiers and which are days.

    ``packed`` names a column that holds the days as one array of texts, where there are no day columns.
    ``scanned``: the rows stand where the files have them, so file order is known.
    """

    df: DataFrame
    id_columns: list[str]
    day_columns: list[str]
    start_date: _dt.date | None
    packed: str | None = None
    scanned: bool = True

    @property
    def n_days(self) -> int:
        return len(self.day_columns)

    @property
    def days(self):
        """The days of a row as one array of texts (Column)."""
        if self.packed:
            return F.col(f"`{self.packed}`")
        return F.array(*[F.col(f"`{c}`") for c in self.day_columns]).cast("array<string>")


def read_wide_csv(spark: SparkSession, path, n_ids: int | None = None,
                  start_date: _dt.date | None = None, check_headers: bool = True,
                  multi_line: bool | str = False, flag_malformed: bool = False) -> WideFile:
    """Read a wide series file; the header splits identifier columns from day columns.

    Day columns are the header names that parse as ``M/d/yy``; they must be
    consecutive days with no gap (otherwise every later day would be misdated).
    With ``n_ids`` the first ``n_ids`` columns are identifiers and the rest are
    days whatever their names (a header without dates then needs ``start_date``).
    ``check_headers``, ``multi_line`` and ``flag_malformed`` are those of :func:`read_table_csv`: files
    whose day columns differ fail while they are read (:func:`read_wide_releases` takes them).
    """
    df = read_table_csv(spark, path, multi_line=multi_line, check_headers=check_headers, flag_malformed=flag_malformed)
    cols = [c for c in df.columns if c != CORRUPT_COLUMN]
    if n_ids is None:
        n_ids = next((i for i, c in enumerate(cols) if parse_header_day(c) is not None), len(cols))
    ids, days = cols[:n_ids], cols[n_ids:]
    dates = [parse_header_day(c) for c in days]
    if days and all(d is not None for d in dates):
        for a, b in zip(dates, dates[1:]):
            if (b - a).days != 1:
                raise ValueError(f"day columns are not consecutive: {a} then {b}")
        start = start_date or dates[0]
    else:
        start = start_date
    return WideFile(df=df, id_columns=ids, day_columns=days, start_date=start, scanned=multi_line != "split")


def read_wide_releases(spark: SparkSession, path, keys: Sequence[str | int] | None = None, ids: Sequence[str] | None = None,
                       aliases: dict[str, str] | None = None, multi_line: bool | str = False) -> WideFile:
    """Several releases of one wide series file, whose day columns differ, as one file over all their days.

    Every file is mapped by its own header: identifier columns by name (``aliases`` gives the name to use for
    another spelling; one that a file lacks is null), day columns by their date, in any
    order and with gaps. ``ids`` lists the identifiers and their order; without it they are all that occur, in
    the order of the first file by path. Days run from the first to the last of all files; a day that a file lacks is null.

    Without ``keys`` the rows of all files stand side by side. With ``keys`` (identifier names or positions) a
    place has one row: for each day and identifier the value of the newest release that has one. Newer is
    the file with the later last day, then the later path. A file that holds a key twice raises.

    One header line per file is read here. Files with equal headers are one scan. Merging gathers one row per
    release and place, so a group is bounded by the number of files.
    """
    aliases = aliases or {}
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise ValueError(f"no files under {path}")
    with ThreadPoolExecutor(max_workers=8) as pool:
        headers = list(pool.map(lambda f: tuple(_reader(spark, True, bool(multi_line)).csv(f).columns), files))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for f, h in zip(files, headers, strict=True):
        layouts.setdefault(h, []).append(f)
    days = {h: {d: c for c in h if (d := parse_header_day(c)) is not None} for h in layouts}
    named = {h: {aliases.get(c, c): c for c in h if parse_header_day(c) is None} for h in layouts}
    ids = list(ids or dict.fromkeys(n for h in layouts for n in named[h]))
    dates = [d for h in layouts for d in days[h]]
    start = min(dates, default=None)
    calendar = [start + _dt.timedelta(days=i) for i in range((max(dates) - start).days + 1)] if dates else []
    none = F.lit(None).cast("string")
    rows = None
    for h, paths in layouts.items():
        of = lambda c: F.col(f"`{c}`")
        newest = F.lit(max(days[h], default=None)).cast("date").alias("last")
        # A path is not known of records put together from lines; such files are ranked by their layout's first.
        at = (F.lit(paths[0]) if multi_line == "split" else F.col("_metadata.file_path")).alias("file")
        one = read_table_csv(spark, paths, multi_line=multi_line).select(
            *[(of(named[h][n]) if n in named[h] else none).alias(n) for n in ids],
            F.array(*[of(days[h][d]) if d in days[h] else none for d in calendar]).cast("array<string>").alias("_days"),
            F.struct(newest, at).alias("_release"))
        rows = one if rows is None else rows.unionByName(one)
    if keys is not None:
        rows = _newest(rows, [ids[k] if isinstance(k, int) else k for k in keys], ids)
    return WideFile(df=rows.select(*[F.col(f"`{n}`") for n in ids], "_days"), id_columns=ids,
                    day_columns=[header_day_name(d) for d in calendar], start_date=start, packed="_days", scanned=False)


def _newest(rows: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """One row per key from the releases' rows, the newest value first."""
    q = lambda c: F.col(f"`{c}`")
    rest = [c for c in ids if c not in keys]
    gathered = rows.groupBy(*[q(k) for k in keys]).agg(F.sort_array(F.collect_list(F.struct(
        "_release", *[q(c).alias(f"_v{i}") for i, c in enumerate(rest)], "_days")), asc=False).alias("_rows"))
    files = F.transform("_rows", lambda r: r["_release"]["file"])
    twice = F.raise_error(F.lit("a file holds a place key twice")).cast("boolean")

    def value(i: int):
        return F.get(F.filter(F.transform("_rows", lambda r: r[f"_v{i}"]), lambda v: v.isNotNull()), 0)

    single = gathered.where(F.when(F.size(F.array_distinct(files)) < F.size(files), twice).otherwise(True))
    return single.select(
        *[q(k) for k in keys],
        *[value(i).alias(c) for i, c in enumerate(rest)],
        F.aggregate(F.slice("_rows", 2, F.size("_rows")), F.get("_rows", 0)["_days"],
                    lambda newer, r: F.zip_with(newer, r["_days"], lambda a, b: F.coalesce(a, b))).alias("_days"))


def read_lines(spark: SparkSession, path, drop_header: bool = True) -> DataFrame:
    """Raw lines (column ``value``); with ``drop_header`` the first line of every file
    is dropped, whatever its text (the reference dropped it from the first
    partition only). One narrow scan: the CSV reader with U+0001 as separator and without quotes leaves a line
    whole; one that holds U+0001 it flags as malformed, and its raw text is taken. Blank lines (no character
    above U+0020) hold no record and are passed over."""
    lines = (spark.read.schema(f"value string, {CORRUPT_COLUMN} string").option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
             .option("header", drop_header).option("sep", "\u0001").option("quote", "").option("escape", "").csv(path))
    return lines.select(F.coalesce(CORRUPT_COLUMN, "value").alias("value")).where(F.col("value").isNotNull())


def bad_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Raw lines without defined fields: an odd number of quotes."""
    return lines.where(~balanced_quotes(col))


def tokenised_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Each raw line split into ``tokens: array<string>`` the way the reference's
    tokenizer does (commas outside quotes, quotes deleted, empty -> null)."""
    return lines.select(split_quoted(col).alias("tokens"))


def malformed_rows(spark: SparkSession, path) -> DataFrame:
    """Rows of a CSV source whose field count does not match its header (too few,
    too many, or an unclosed quote), with the raw line in ``_corrupt_record``."""
    return read_table_csv(spark, path, flag_malformed=True).where(F.col(CORRUPT_COLUMN).isNotNull())
