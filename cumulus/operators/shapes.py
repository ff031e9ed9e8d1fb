"""Reshaping between the three forms of a series.

* horizontal: one row per place, all days in one ``array<bigint>`` (index = day offset)
* vertical:   one row per place and day
* unpacked:   one row per place, one column per day (an export form only: hundreds
  of columns defeat whole-stage codegen, so no query works on it)

All jobs here are narrow except ``to_horizontal`` (one shuffle on the place key,
with map-side partial aggregation) and ``dense_ordinal`` (a write of the tagged
input, after one range-partitioned sort when ``order_by`` is given).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.functions.dates import day_label

#: Offsets (one row per partition and group) up to which they are broadcast.
MAX_BROADCAST_ROWS = 500_000


def _date_col(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value).cast("date")


def dense_ordinal(df: DataFrame, name: str = "id", order_by: Sequence[str] | None = None,
                  within: Sequence[str] | None = None) -> DataFrame:
    """ACTION: append a 0-based, gap-free row number (what ``RDD.zipWithIndex`` gives).

    Without ``order_by`` the numbering follows the input's partition order (file
    order for a single-file scan); with it, rows are first range-sorted, so the
    number is the rank in that order (nulls first, as Spark sorts ascending).
    With ``within``, numbering restarts at 0 in every group of those columns
    (e.g. a row number per file): rows are sorted by the group first.
    Rows tied on ``order_by`` are broken by input position, so the sort can
    spread even a key held by a third of all rows over many tasks.

    Distributed: each row gets (partition index, position in partition) from
    ``spark_partition_id`` / ``monotonically_increasing_id``. That tagged frame is
    written once to the shared checkpoint folder, so the numbering comes from
    exactly one evaluation. Otherwise the count pass and the numbering pass are
    planned separately: they are pruned differently, are not shared, and under
    AQE may be split into different partitions. A running sum over the counts
    per partition and group gives the offsets; they are broadcast back if there are at
    most ``MAX_BROADCAST_ROWS``, else joined on partition and group. No row goes through the
    driver. ``session.releasing`` deletes the written frame after use. A partition may hold
    up to 2**33 rows (the position part of the generated id).
    """
    from cumulus.session import materialize

    sort_keys = [*(within or []), *(order_by or [])]
    if sort_keys:
        src = df.select("*", F.monotonically_increasing_id().alias("_tie")).orderBy(*sort_keys, "_tie")
    else:
        src = df
    tagged = materialize(src.select(
        *[F.col(c) for c in df.columns],
        F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().alias("_mid"),
    ), "ordinal")
    # Rows lie sorted by group, so a group's rows in one partition are consecutive: their number is
    # their distance from the first one there plus the group's rows in earlier partitions.
    groups = list(within or [])
    per_part = materialize(tagged.groupBy("_pid", *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_from")), "ordinal-counts")
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", *groups, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_off"))
    t, o = tagged.alias("_t"), (F.broadcast(offsets) if per_part.count() <= MAX_BROADCAST_ROWS else offsets).alias("_o")
    cond = F.col("_t._pid") == F.col("_o._pid")
    for k in groups:
        cond = cond & F.col(f"_t.{k}").eqNullSafe(F.col(f"_o.{k}"))
    return t.join(o, cond).select(*[F.col(f"_t.{c}") for c in df.columns], (F.col("_t._mid") + F.col("_o._off")).alias(name))


def to_horizontal(
    vertical: DataFrame,
    keys: Sequence[str],
    value,
    start_date,
    n_days=None,
    date_col: str = "date",
    out: str | None = None,
) -> DataFrame:
    """Pack a vertical series into one array per place.

    Position i of the array holds the value of day ``start_date + i``; days a place
    lacks are null, so gaps never shift later days. ``n_days`` (int or Column)
    fixes the array length; by default it runs to the place's last day. A day before
    ``start_date`` or past a fixed length raises: no value is dropped.
    ``value`` may be a list of measures: all are packed in the same pass, one
    array column each (named after the measure); a single measure gives ``out``
    (default ``counts``).

    One shuffle on ``keys``. Each group holds one entry per day of one place, so
    its size is bounded by the calendar, not by the data volume. Two values for
    the same place and day raise (Spark's duplicate-map-key error) rather than
    silently keeping one.
    """
    values = [value] if isinstance(value, str) else list(value)
    names = [out or "counts"] if isinstance(value, str) else values
    start = _date_col(start_date)
    offset = F.datediff(F.col(date_col), start)
    grouped = vertical.groupBy(*keys).agg(
        # One list for all measures, so the day is shuffled and sorted once.
        F.array_sort(F.collect_list(F.struct(offset.alias("k"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
                     ).alias("_e"),
        F.min(offset).alias("_first"), F.max(offset).alias("_last"),
    )
    length = F.lit(n_days) if isinstance(n_days, int) else (n_days if n_days is not None else F.col("_last") + 1)
    # The length may be a scalar subquery, which Spark does not allow inside a
    # higher-order function: project it to a column first.
    grouped = grouped.withColumn("_len", length)
    outside = F.raise_error(F.concat(F.lit("a day lies outside the array: offsets "), F.col("_first"), F.lit(" to "),
                                     F.col("_last"), F.lit(", length "), F.col("_len"))).cast("int")
    grouped = grouped.withColumn("_len", F.when((F.col("_first") < 0) | (F.col("_last") >= F.col("_len")), outside)
                                 .otherwise(F.col("_len")))

    def complete():
        # Sorted entries with offsets exactly 0.._len-1, each once.
        e = F.col("_e")
        ks = F.transform(e, lambda x: x["k"])
        return ((F.size(e) == F.col("_len")) & (F.size(F.array_distinct(ks)) == F.size(e))
                & (F.get(ks, 0) == 0) & (F.get(ks, F.col("_len") - 1) == F.col("_len") - 1))

    # Complete series are read straight off the sorted entries (linear). Others
    # (gaps, duplicates, days past _len) get a day -> value map, built once per
    # row and only for them: gaps become null, duplicate days raise.
    n = len(values)
    def pair(i):
        return lambda x: F.struct(x["k"], x[f"v{i}"])

    grouped = grouped.select(
        *keys, "_len", "_e", F.coalesce(complete(), F.lit(False)).alias("_c"),
    ).select(
        *keys, "_len", "_e", "_c",
        *[F.when(~F.col("_c") & (F.col("_len") > 0), F.map_from_entries(
            F.transform("_e", pair(i)))).alias(f"_m{i}") for i in range(n)],
    )

    def packed(i):
        direct = F.transform(F.col("_e"), lambda x: x[f"v{i}"])
        by_day = F.transform(F.sequence(F.lit(0), F.col("_len") - 1),
                             lambda d: F.try_element_at(F.col(f"_m{i}"), d))
        return (F.when(F.col("_len") <= 0, F.array().cast("array<bigint>"))
                .when(F.col("_c"), direct).otherwise(by_day).cast("array<bigint>"))

    return grouped.select(*keys, *[packed(i).alias(n) for i, n in enumerate(names)])


def to_vertical(
    horizontal: DataFrame,
    ids: Sequence[str],
    start_date,
    counts: str = "counts",
    value: str = "counts",
    date_col: str = "date",
    id_col: str | None = "id",
    id_order: Sequence[str] | None = None,
) -> DataFrame:
    """Unpack arrays into one row per place and day; day i is dated ``start_date + i``.

    Null elements are kept (a null count is a row with a null value); a null or
    empty array gives no rows. With ``id_col``, every place gets a dense ordinal
    (see :func:`dense_ordinal`, which writes the places once: an action;
    ``id_order`` sorts first) carried onto its rows. With ``id_col=None`` the
    job is lazy and narrow.
    """
    src = horizontal
    lead = []
    if id_col:
        src = dense_ordinal(horizontal, id_col, id_order)
        lead = [id_col]
    start = _date_col(start_date)
    exploded = src.select(*lead, *ids, F.posexplode(F.col(counts)).alias("_pos", "_v"))
    return exploded.select(
        *lead, *ids,
        F.date_add(start, F.col("_pos")).alias(date_col),
        F.col("_v").alias(value),
    )


def to_vertical_many(
    frames: dict[str, DataFrame],
    ids: Sequence[str],
    start_date,
    id_order: Sequence[str] | None = None,
    counts: str = "counts",
    value: str = "counts",
    date_col: str = "date",
    id_col: str = "id",
) -> dict[str, DataFrame]:
    """ACTION (one ordinal write): :func:`to_vertical` with ids for several files of the
    same layout at once.

    Each file's places are numbered from 0 as ``to_vertical`` would, but in one
    ordinal pass (one sort, one written table) over all files together, tagged
    by file, instead of one pass per file.
    """
    names = list(frames)
    tagged = None
    for i, k in enumerate(names):
        f = frames[k].select(F.lit(i).alias("_file"), *ids, counts)
        tagged = f if tagged is None else tagged.unionByName(f)
    numbered = dense_ordinal(tagged, id_col, id_order, within=["_file"])
    out = {}
    for i, k in enumerate(names):
        one = numbered.where(F.col("_file") == i).drop("_file")
        out[k] = to_vertical(one, [id_col, *ids], start_date, counts=counts, value=value, date_col=date_col,
                             id_col=None)
    return out


def series_width(df: DataFrame, counts: str = "counts") -> int:
    """ACTION: the longest array in ``counts`` (0 for no rows).

    An unpacked frame has one column per day, so its schema depends on this number;
    it is one distributed ``max(size)`` aggregate returning a single value.
    """
    width = df.agg(F.max(F.size(F.col(counts)))).first()[0]
    return int(width or 0)


def to_unpacked(
    horizontal: DataFrame,
    ids: Sequence[str],
    counts: str,
    start_date: _dt.date,
    n_days: int,
    namer=None,
) -> DataFrame:
    """One column per day named by its date label ("Jan 22 '20", or ``namer(date)``);
    a narrow projection.

    Past the end of a short array, or on a null array, the cell is null. An array
    longer than ``n_days`` raises.
    """
    if isinstance(start_date, str):
        start_date = _dt.date.fromisoformat(start_date)
    arr = F.col(counts)
    if namer is None:
        labels = [day_label(start_date, i) for i in range(n_days)]
    else:
        labels = [namer(start_date + _dt.timedelta(days=i)) for i in range(n_days)]
    too_long = F.raise_error(F.concat(F.lit("a series is longer than the columns: "), F.size(arr))).cast("boolean")
    whole = horizontal.where(F.when(F.size(arr) > n_days, too_long).otherwise(True))
    return whole.select(*ids, *[F.get(arr, i).alias(lbl) for i, lbl in enumerate(labels)])
