"""DataFrame-to-DataFrame jobs: reshaping, merging, growth and cleaning."""

from cumulus.operators.file_order import file_ordinal
from cumulus.operators.growth import growth_horizontal, growth_vertical, growth_vertical_spread
from cumulus.operators.merge import merge_global, merge_global_vertical, merge_us, merge_us_vertical
from cumulus.operators.shapes import (
    dense_ordinal,
    series_width,
    to_horizontal,
    to_unpacked,
    to_vertical,
    to_vertical_many,
)

__all__ = [
    "dense_ordinal", "file_ordinal", "growth_horizontal", "growth_vertical", "growth_vertical_spread", "merge_global", "merge_global_vertical",
    "merge_us", "merge_us_vertical", "series_width", "to_horizontal", "to_unpacked", "to_vertical", "to_vertical_many",
]
