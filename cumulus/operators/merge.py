"""Merging separately loaded measures of the same places.

Each merge is a full outer join with null-safe equality on the place key (a
null region is a real key value: the country-level row), of two or three files
that hold a key once. It is written as one union grouped by the key, and a filter on the key goes
below it to every file's scan: one shuffle whatever the number of files, and none
for files stored by key (``session.materialize_by_key``), whose union keeps their
partitioning. Identity columns come from the first file that
has them, so a row present in one file only keeps its identity. (The reference kept
only the left side's columns, which blanked right-only rows.) A key that a file
holds twice raises instead of multiplying rows.

Numbers, dates and other values of fixed width are merged by hash aggregation with ``max``. Arrays and
strings have no place in a hash aggregate's buffer, and ``max`` over them sorts whole rows before
and after the shuffle; so those files' rows are gathered as structs (an object hash aggregate, without a
sort in the plan), and the struct of each file is taken apart once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from cumulus.schemas import GLOBAL_KEYS, US_IDS

_VARIABLE = (ArrayType, BinaryType, MapType, StringType, StructType)


def _outer_merge(files: Sequence[DataFrame], measures: Sequence[str], keys: Sequence[str], identity: Sequence[str],
                 counts: str, last_first: Sequence[str] = ()) -> DataFrame:
    """Full outer merge of ``files`` on ``keys``: file i's ``counts`` becomes ``measures[i]``; the
    ``identity`` columns come from the first file (the last for names in ``last_first``) that has a value."""
    types = {f.name: f.dataType for df in reversed(files) for f in df.schema.fields}
    tagged = None
    for i, df in enumerate(files):
        one = df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in identity],
                        F.col(counts).alias("_v"), F.lit(i).alias("_f"))
        tagged = one if tagged is None else tagged.unionByName(one)
    gather = any(isinstance(types[c], _VARIABLE) for c in (*identity, counts))
    merged = (_gathered if gather else _maxima)(tagged, len(files), keys, identity)
    n = range(len(files))
    twice = F.raise_error(F.lit("a file holds a place key twice")).cast("boolean")
    return merged.where(F.when(F.col("_repeated"), twice).otherwise(True)).select(
        *keys, *[F.coalesce(*[F.col(f"_{i}.{c}") for i in (reversed(n) if c in last_first else n)]).alias(c) for c in identity],
        *[F.col(f"_{i}._v").alias(m) for i, m in enumerate(measures)])


def _maxima(tagged: DataFrame, n: int, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Per key a struct _0, _1, ... of each file's values, and whether a file has the key twice."""
    of = lambda c, i: F.max(F.when(F.col("_f") == i, F.col(c)))
    grouped = tagged.groupBy(*keys).agg(
        *[of(c, i).alias(f"_{i}_{c}") for i in range(n) for c in (*identity, "_v")],
        F.greatest(F.lit(0), *[F.count_if(F.col("_f") == i) for i in range(n)]).alias("_times"))
    return grouped.select(*keys, (F.col("_times") > 1).alias("_repeated"), *[F.struct(
        *[F.col(f"_{i}_{c}").alias(c) for c in (*identity, "_v")]).alias(f"_{i}") for i in range(n)])


def _gathered(tagged: DataFrame, n: int, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """As :func:`_maxima`, from at most ``n`` structs gathered per key."""
    grouped = tagged.groupBy(*keys).agg(F.collect_list(F.struct("_f", *identity, "_v")).alias("_rows"))
    files = F.transform("_rows", lambda r: r["_f"])

    def of(i: int):
        return F.get(F.filter("_rows", lambda r: r["_f"] == i), 0)

    return grouped.select(*keys, (F.size(F.array_distinct(files)) < F.size(files)).alias("_repeated"),
                          *[of(i).alias(f"_{i}") for i in range(n)])


def merge_global(confirmed: DataFrame, deaths: DataFrame, recovered: DataFrame,
                 keys: Sequence[str] = GLOBAL_KEYS, counts: str = "counts") -> DataFrame:
    """Three horizontal global series to one frame with ``confirmed``, ``deaths``, ``recovered`` arrays."""
    merged = _outer_merge((confirmed, deaths, recovered), ("confirmed", "deaths", "recovered"), keys,
                          ("latitude", "longitude"), counts)
    return merged.select(*[c for c in confirmed.columns if c != counts], "confirmed", "deaths", "recovered")


def merge_us(confirmed: DataFrame, deaths: DataFrame, key: str = "uid", counts: str = "counts") -> DataFrame:
    """US confirmed (no population) and deaths (with population), merged on ``uid``.

    Gives the identity columns, ``confirmed``, ``deaths`` and one ``population``
    (from the deaths file, else from confirmed).
    """
    identity = [c for c in US_IDS if c != key] + ["population"]
    merged = _outer_merge((confirmed, deaths), ("confirmed", "deaths"), [key], identity, counts, ("population",))
    return merged.select(*US_IDS, "confirmed", "deaths", "population")


def merge_global_vertical(confirmed: DataFrame, deaths: DataFrame, recovered: DataFrame,
                          keys: Sequence[str] = GLOBAL_KEYS, date_col: str = "date",
                          counts: str = "counts") -> DataFrame:
    """Vertical global series merged on (place key, date).

    The reference aligned the files by row ordinal, which pairs different places
    when the files' rows differ; the place key is used instead and ``id`` is
    still returned (the first file's ordinal where the row exists there).
    """
    merged = _outer_merge((confirmed, deaths, recovered), ("confirmed", "deaths", "recovered"), [*keys, date_col],
                          ("id", "latitude", "longitude"), counts)
    return merged.select(*[c for c in confirmed.columns if c != counts], "confirmed", "deaths", "recovered")


def merge_us_vertical(confirmed: DataFrame, deaths: DataFrame, key: str = "uid",
                      date_col: str = "date", counts: str = "counts") -> DataFrame:
    """Vertical US series merged on (uid, date)."""
    identity = [c for c in US_IDS if c != key] + ["population"]
    merged = _outer_merge((confirmed, deaths), ("confirmed", "deaths"), [key, date_col], identity, counts, ("population",))
    return merged.select(*US_IDS, date_col, "confirmed", "deaths", "population")
