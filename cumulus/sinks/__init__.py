"""CSV writer and previews (K1-K4)."""

from cumulus.sinks.csv import join_parts, preview, preview_rows, wide_lines, write_csv, write_wide_csv

__all__ = ["join_parts", "preview", "preview_rows", "wide_lines", "write_csv", "write_wide_csv"]
