"""The input catalogue (S4) and SQL views over it.

``load_all`` reads the seven raw inputs of a data folder into typed, lazy
DataFrames (one header read per wide file, nothing else runs). ``register_views``
makes any set of frames visible to ``spark.sql`` under given names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cumulus.operators import cleaning
from cumulus.sources.csv import read_table_csv, read_wide_csv, read_wide_releases

# File names of the seven inputs inside a data folder.
INPUT_FILES = {
    "places": "uid_lookup_table.csv",
    "global_confirmed": "time_series_covid_19_confirmed.csv",
    "global_deaths": "time_series_covid_19_deaths.csv",
    "global_recovered": "time_series_covid_19_recovered.csv",
    "us_confirmed": "time_series_covid_19_confirmed_US.csv",
    "us_deaths": "time_series_covid_19_deaths_US.csv",
    "observation_log": "covid_19_data.csv",
}


def load_all(spark: SparkSession, folder: str, files: dict[str, str] | None = None,
             check_headers: bool = True, releases: bool = False) -> dict[str, DataFrame]:
    """Typed frames of every input found under ``folder`` (a name may map to a file or folder).

    Keys: ``places``, ``global_confirmed`` / ``global_deaths`` / ``global_recovered``
    (horizontal), ``us_confirmed`` / ``us_deaths`` (horizontal; deaths with
    population), ``observation_log``. Series start dates come from the headers.
    With ``check_headers``, an input stored as several files whose headers differ
    is rejected (see ``read_wide_csv``). With ``releases``, the series inputs may be folders of several
    releases with other day columns: the newest value of each place and day is taken
    (see ``read_wide_releases``; each series starts on its first day).
    """
    names = {**INPUT_FILES, **(files or {})}
    path = {k: f"{folder.rstrip('/')}/{v}" for k, v in names.items()}
    out: dict[str, DataFrame] = {
        "places": cleaning.place_dim(read_table_csv(spark, path["places"])),
        "observation_log": cleaning.observation_log(read_table_csv(spark, path["observation_log"])),
    }
    def wide(key):
        if releases:
            return read_wide_releases(spark, path[key], keys=[0] if key.startswith("us_") else [0, 1])
        return read_wide_csv(spark, path[key], check_headers=check_headers)

    for m in ("confirmed", "deaths", "recovered"):
        out[f"global_{m}"] = cleaning.global_horizontal(wide(f"global_{m}"))
    out["us_confirmed"] = cleaning.us_horizontal(wide("us_confirmed"))
    out["us_deaths"] = cleaning.us_horizontal(wide("us_deaths"), with_population=True)
    return out


def register_views(frames: dict[str, DataFrame]) -> None:
    """``createOrReplaceTempView`` for each (name, frame), so SQL text can use them."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
