"""Typing and cleaning of the raw inputs.

All are single narrow projections over the reader's text columns: no shuffle,
built-in expressions only. Columns are taken by position, as in the source
files (header names differ between releases of the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.dates import observed_date, update_date
from cumulus.functions.parse import code_or_zero, coordinate, float_text_long, measure_long, try_long
from cumulus.functions.text import normalise_country, normalise_region
from cumulus.operators.file_order import file_ordinal
from cumulus.operators.shapes import to_vertical
from cumulus.schemas import GLOBAL_IDS, US_IDS
from cumulus.sources.csv import CORRUPT_COLUMN, WideFile


def _pos(df: DataFrame, i: int):
    return F.col(f"`{df.columns[i]}`")


def _counts(wide: WideFile):
    if wide.packed:
        return F.transform(wide.days, lambda v: v.try_cast("bigint")).alias("counts")
    return F.array(*[try_long(F.col(f"`{c}`")) for c in wide.day_columns]).cast("array<bigint>").alias("counts")


def _require_ids(wide: WideFile, n: int, what: str) -> None:
    if len(wide.id_columns) < n:
        raise ValueError(f"{what} needs {n} identifier columns before the day columns, "
                         f"found {len(wide.id_columns)}: {wide.id_columns}")


def global_horizontal(wide: WideFile) -> DataFrame:
    """Global series file to (region, country, latitude, longitude, counts)."""
    _require_ids(wide, 4, "a global series file")
    df = wide.df
    return df.select(
        _pos(df, 0).alias("region"), _pos(df, 1).alias("country"),
        coordinate(_pos(df, 2)).alias("latitude"), coordinate(_pos(df, 3)).alias("longitude"),
        _counts(wide),
    )


def global_vertical(wide: WideFile, id_order=None) -> DataFrame:
    """ACTION: global series file to one row per place and day, with a row-ordinal ``id``: the row's place
    in its file, files by path (counts the rows once, see :func:`file_ordinal`), or the rank in
    ``id_order`` (writes the places once). Null counts are kept."""
    places = global_horizontal(wide)
    if id_order is None and wide.scanned:
        return to_vertical(file_ordinal(places), ["id", *GLOBAL_IDS], wide.start_date, id_col=None)
    return to_vertical(places, GLOBAL_IDS, wide.start_date, id_order=id_order)


def _us_ids(df: DataFrame):
    return [
        try_long(_pos(df, 0)).alias("uid"), _pos(df, 1).alias("iso2"), _pos(df, 2).alias("iso3"),
        code_or_zero(_pos(df, 3), "int").alias("code3"), code_or_zero(_pos(df, 4)).alias("FIPS"),
        _pos(df, 5).alias("Admin2"), _pos(df, 6).alias("region"), _pos(df, 7).alias("country"),
        coordinate(_pos(df, 8)).alias("latitude"), coordinate(_pos(df, 9)).alias("longitude"),
        _pos(df, 10).alias("combined_key"),
    ]


def us_horizontal(wide: WideFile, with_population: bool = False) -> DataFrame:
    """US series file: 11 identifier columns, then (deaths file) population, then days.

    Read with ``read_wide_csv``, the population column is an identifier column
    (its header is not a date), so the day columns are the same either way.
    """
    _require_ids(wide, 12 if with_population else 11,
                 "a US series file" + (" with population" if with_population else ""))
    df = wide.df
    pop = (try_long(_pos(df, 11)) if with_population else F.lit(None).cast("bigint")).alias("population")
    return df.select(*_us_ids(df), _counts(wide), pop)


def us_vertical(wide: WideFile, with_population: bool = False) -> DataFrame:
    """US series file to one row per place and day (no row id; places carry ``uid``).

    Population comes from its own column and the first day keeps its date (the
    reference read the first day's count as population, and in the file without
    population lost the first day).
    """
    h = us_horizontal(wide, with_population)
    return to_vertical(h, [*US_IDS, "population"], wide.start_date, id_col=None)


def place_dim(df: DataFrame) -> DataFrame:
    """Place lookup file (12 columns) to the typed place dimension.

    Null code3/FIPS stay null (as the reference's lookup parse), FIPS may be float
    text, null coordinates become 0.0, and null population stays null (the
    reference made it 0, which later became a divisor).
    """
    return df.select(
        try_long(_pos(df, 0)).alias("uid"), _pos(df, 1).alias("iso2"), _pos(df, 2).alias("iso3"),
        float_text_long(_pos(df, 3)).try_cast("int").alias("code3"), float_text_long(_pos(df, 4)).alias("FIPS"),
        _pos(df, 5).alias("Admin2"), _pos(df, 6).alias("region"), _pos(df, 7).alias("country"),
        coordinate(_pos(df, 8)).alias("latitude"), coordinate(_pos(df, 9)).alias("longitude"),
        _pos(df, 10).alias("combined_key"), try_long(_pos(df, 11)).alias("population"),
    )


def observation_log(df: DataFrame, pivot: int | None = None) -> DataFrame:
    """Observation log file (8 columns) to the typed log, with region and country repaired.

    ``pivot`` is the two-digit-year rule of :func:`cumulus.functions.dates.update_date`.
    Unparsable dates become null rather than failing the job; see
    :func:`bad_log_rows` for the rows that lost a value.
    """
    typed = df.select(
        try_long(_pos(df, 0)).alias("id"),
        observed_date(_pos(df, 1)).alias("observed_date"),
        _pos(df, 2).alias("region"), _pos(df, 3).alias("country"),
        update_date(_pos(df, 4), pivot=pivot).alias("last_updated"),
        measure_long(_pos(df, 5)).alias("confirmed"),
        measure_long(_pos(df, 6)).alias("deaths"),
        measure_long(_pos(df, 7)).alias("recovered"),
    )
    return typed.select(
        "id", "observed_date",
        normalise_region("region", "country").alias("region"),
        normalise_country("country").alias("country"),
        "last_updated", "confirmed", "deaths", "recovered",
    )


def _unparsed(df: DataFrame, checks) -> DataFrame:
    bad = F.col(CORRUPT_COLUMN).isNotNull() if CORRUPT_COLUMN in df.columns else F.lit(False)
    for raw, parsed in checks:
        bad = bad | (raw.isNotNull() & parsed.isNull())
    return df.where(bad)


def bad_log_rows(df: DataFrame) -> DataFrame:
    """Raw log rows where a non-empty field did not parse, and rows with the wrong number of
    fields if ``df`` was read with ``flag_malformed``."""
    return _unparsed(df, [
        (_pos(df, 0), try_long(_pos(df, 0))),
        (_pos(df, 1), observed_date(_pos(df, 1))),
        (_pos(df, 4), update_date(_pos(df, 4))),
        *[(_pos(df, i), measure_long(_pos(df, i))) for i in (5, 6, 7)],
    ])


def bad_series_rows(wide: WideFile, us: bool = False) -> DataFrame:
    """Raw rows of a series file where a coordinate, a code or a count that is not empty did
    not parse, and rows with the wrong number of fields if read with ``flag_malformed``."""
    df = wide.df
    at = {i: (_pos(df, i), _pos(df, i).try_cast("float")) for i in ((8, 9) if us else (2, 3))}
    if us:
        at[0] = (_pos(df, 0), try_long(_pos(df, 0)))
        at |= {i: (_pos(df, i), float_text_long(_pos(df, i))) for i in (3, 4)}
    # One test over the array of days, however many there are.
    lost = F.coalesce(F.exists(wide.days, lambda v: v.isNotNull() & v.try_cast("bigint").isNull()), F.lit(False))
    return _unparsed(df, [*at.values(), (F.lit(True), F.when(~lost, True))])


def bad_place_rows(df: DataFrame) -> DataFrame:
    """Raw rows of the place file where a number that is not empty did not parse, and rows with
    the wrong number of fields if read with ``flag_malformed``."""
    return _unparsed(df, [*[(_pos(df, i), try_long(_pos(df, i))) for i in (0, 11)],
                          *[(_pos(df, i), float_text_long(_pos(df, i))) for i in (3, 4)],
                          *[(_pos(df, i), _pos(df, i).try_cast("float")) for i in (8, 9)]])
