"""CSV sinks (K1-K4).

A folder of part files written in parallel, one per partition; an existing
path is an error unless ``mode`` says otherwise. ``single_file`` joins the parts
into one afterwards, through the file system: no task sees all rows.
Array columns cannot be written to CSV: render the series as a wide file (``write_wide_csv``)
or make the frame vertical first.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from collections.abc import Sequence

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.functions.dates import header_day_name
from cumulus.operators.shapes import series_width


def write_csv(df: DataFrame, path: str, include_header: bool = False, single_file: bool = False,
              mode: str = "errorifexists", quote_all: bool = False) -> None:
    """ACTION: write ``df`` as CSV (RFC-4180 quoting, ``""`` for a quote inside a field).

    With ``single_file`` the folder holds one file, rows in the order of the partitions (see :func:`join_parts`);
    ``mode`` may then not be "append".
    """
    if not single_file:
        _writer(df, mode, include_header, quote_all).csv(path)
        return
    header = _line(df.columns, quote_all) if include_header else None
    _write_joined(df.sparkSession, path, mode, header, lambda parts: _writer(df, "errorifexists", False, quote_all).csv(parts))


def _writer(df: DataFrame, mode: str, header: bool, quote_all: bool):
    return (df.write.mode(mode).option("header", header).option("quote", '"').option("escape", '"')
            .option("quoteAll", quote_all)
            # Spark's writer strips blanks from values unless told otherwise.
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def _line(values: Sequence[str], quote_all: bool) -> str:
    return ",".join('"' + v.replace('"', '""') + '"' if quote_all or re.search(r'[",\r\n]', v) else v for v in values)


def _cell(c: Column, quote_all: bool) -> Column:
    """A value as a CSV field: null is empty, quotes where the text needs them."""
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))
    needs = F.lit(True) if quote_all else text.rlike('[",\r\n]')
    return F.coalesce(F.when(needs, quoted).otherwise(text), F.lit(""))


def wide_lines(horizontal: DataFrame, ids: Sequence[str], counts: str, start_date: _dt.date, n_days: int,
               quote_all: bool = False, header: bool = True) -> DataFrame:
    """A horizontal series as the lines of a wide file (column ``value``): identifiers, then a field per day headed
    "M/d/yy". With ``header`` the first row of every partition carries the header line before its own.

    The days are rendered from the array in one expression, and so is the header, so the plan has the
    same size whatever the number of days (one column per day would pass the width that Spark
    compiles). Past the end of a short array, or of a null one, fields are empty; a longer array raises.
    """
    arr = F.col(f"`{counts}`")
    too_long = F.raise_error(F.concat(F.lit("a series is longer than the columns: "), F.size(arr))).cast("string")
    fields = [_cell(F.col(f"`{c}`"), quote_all) for c in ids]
    names = [F.lit(_line(ids, quote_all))] if ids else []
    if n_days > 0:
        mark = F.lit('"' if quote_all else "")
        each = F.sequence(F.lit(0), F.lit(n_days - 1))
        day = lambda i: F.coalesce(F.concat(mark, F.get(arr, i).cast("string"), mark), F.lit(""))
        fields.append(F.array_join(F.transform(each, day), ","))
        name = lambda i: F.concat(mark, F.date_format(F.date_add(F.lit(start_date).cast("date"), i), "M/d/yy"), mark)
        names.append(F.array_join(F.transform(each, name), ","))
    line = F.when(F.size(arr) > n_days, too_long).otherwise(F.concat_ws(",", *fields))
    if header:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        line = F.when(first, F.concat(F.concat_ws(",", *names), F.lit("\n"), line)).otherwise(line)
    return horizontal.select(line.alias("value"))


def write_wide_csv(horizontal: DataFrame, path: str, ids: Sequence[str], counts: str, start_date: _dt.date,
                   n_days: int | None = None, mode: str = "errorifexists", quote_all: bool = False, single_file: bool = False) -> None:
    """ACTION: write a horizontal series as a wide file: ids, then one field per day
    headed "M/d/yy" (the layout ``read_wide_csv`` reads), see :func:`wide_lines`. The width is ``n_days`` or, if not
    given, that of the longest series. Every part file has the header; without rows there is one that has nothing else."""
    spark = horizontal.sparkSession
    if n_days is None:
        n_days = series_width(horizontal, counts)
    days = [header_day_name(start_date + _dt.timedelta(days=i)) for i in range(n_days)]
    header = _line([*ids, *days], quote_all)

    def write(folder: str, how: str = "errorifexists") -> None:
        lines = wide_lines(horizontal, ids, counts, start_date, n_days, quote_all, header=not single_file)
        # A part must not be cut into files of which only the first would have the header.
        lines.write.mode(how).option("maxRecordsPerFile", 0).text(folder)

    if single_file:
        _write_joined(spark, path, mode, header, write)
        return
    write(path, mode)
    files = _Files(spark, path)
    if not any(size for _, size in files.parts(path)):
        files.create(f"{path.rstrip('/')}/part-00000-header.csv", header)


def preview(df: DataFrame, n: int = 20, truncate: bool = True) -> None:
    """ACTION: print the first ``n`` rows (a limit, not a full scan where the plan allows)."""
    df.show(n, truncate=truncate)


def preview_rows(df: DataFrame, n: int = 20, truncate: int = 20) -> DataFrame:
    """The first ``n`` rows as :func:`preview` prints them: every value as text, null as NULL, longer ones
    than ``truncate`` characters cut to end in "..." (0 keeps them whole)."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL"))
        if truncate <= 0:
            return text.alias(c)
        cut = F.substring(text, 1, truncate) if truncate < 4 else F.concat(F.substring(text, 1, truncate - 3), F.lit("..."))
        return F.when(F.char_length(text) > truncate, cut).otherwise(text).alias(c)

    return df.limit(n).select(*[cell(c) for c in df.columns])


class _Files:
    """Hadoop's file system of a path: whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        # A local file system's checksums lie in files of their own, which joining would leave stale.
        self.local = bool(is_instance_of(self.gateway, self.fs, "org.apache.hadoop.fs.ChecksumFileSystem"))
        self.raw = self.fs.getRawFileSystem() if self.local else self.fs

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def parts(self, folder: str) -> list[tuple[str, int]]:
        """Part files and their sizes, in the order of their partitions."""
        found = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in self.fs.listStatus(self.path(folder))]
        return [(p, size) for name, p, size in sorted(found, key=lambda f: (int((re.findall(r"^part-(\d+)", f[0]) or [-1])[0]), f[0]))
                if name.startswith("part-")]

    def create(self, name: str, line: str) -> None:
        out = self.raw.create(self.path(name), True)
        out.write(bytearray((line + "\n").encode()))
        out.close()


def join_parts(spark: SparkSession, folder: str, header: str | None = None) -> None:
    """ACTION: make the part files of ``folder`` one, after a line ``header``, in the order of their partitions.

    The file system joins them (Hadoop's ``concat``): on HDFS the blocks change hands and no byte is read; the
    local file system copies them. Stores that cannot raise, and the parts stay as they are.
    """
    files = _Files(spark, folder)
    parts = files.parts(folder)
    full = [p for p, size in parts if size]
    lead = f"{folder.rstrip('/')}/part-00000-header.csv"
    if header is not None:
        files.create(lead, header)
        full.insert(0, lead)
    joined = full[0] if full else parts[0][0] if parts else None
    if len(full) > 1:
        # HDFS appends to the first file, the local file system writes the file named anew.
        joined, rest = (f"{folder.rstrip('/')}/part-00000-joined.csv", full) if files.local else (full[0], full[1:])
        sources = files.gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(rest))
        for i, p in enumerate(rest):
            sources[i] = files.path(p)
        try:
            files.raw.concat(files.path(joined), sources)
        except Py4JJavaError as error:
            if "UnsupportedOperation" not in str(error.java_exception):
                raise
            if header is not None:
                files.fs.delete(files.path(lead), False)
            raise NotImplementedError(f"the file system of {folder} cannot join files; read the folder of parts, "
                                      "or write df.coalesce(1) where one task can hold all rows") from error
    for p in {*full, *(p for p, _ in parts)}:
        if p != joined:
            files.fs.delete(files.path(p), False)
    if joined is not None:
        name = joined.rpartition("/")[2]
        files.raw.delete(files.path(f"{joined[:-len(name)]}.{name}.crc"), False)


def _write_joined(spark: SparkSession, path: str, mode: str, header: str | None, write) -> None:
    """``write(folder)`` into a hidden folder beside ``path``, its parts joined, then moved to ``path``."""
    if mode not in ("error", "errorifexists", "overwrite", "ignore"):
        raise ValueError(f"a single file cannot be written with mode {mode!r}")
    files = _Files(spark, path)
    target = files.path(path)
    if files.fs.exists(target):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FileExistsError(f"path {path} already exists")
    folder, _, name = path.rstrip("/").rpartition("/")
    parts = f"{folder}/.{name}-{uuid.uuid4().hex}" if folder else f".{name}-{uuid.uuid4().hex}"
    try:
        write(parts)
        join_parts(spark, parts, header)
        if files.fs.exists(target):
            files.fs.delete(target, True)
        if not files.fs.rename(files.path(parts), target):
            raise OSError(f"cannot move the joined file to {path}")
    finally:
        files.fs.delete(files.path(parts), True)
