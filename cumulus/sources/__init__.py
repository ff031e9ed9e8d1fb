"""Readers for the wide series files, raw quoted lines, and the input catalogue."""

from cumulus.sources.csv import (
    WideFile,
    bad_lines,
    malformed_rows,
    read_lines,
    read_records,
    read_table_csv,
    read_wide_csv,
    read_wide_releases,
    tokenised_lines,
)

__all__ = ["WideFile", "bad_lines", "malformed_rows", "read_lines", "read_records", "read_table_csv", "read_wide_csv",
           "read_wide_releases", "tokenised_lines"]


def __getattr__(name):
    # catalogue helpers import the cleaning jobs, so load them lazily
    if name in ("load_all", "register_views", "INPUT_FILES"):
        from cumulus.sources import catalog

        return getattr(catalog, name)
    raise AttributeError(name)
