"""Column expressions: all built-in Spark functions, ANSI-safe (``try_*`` forms)."""

from cumulus.functions.arrays import array_text, day_value, pairwise_growth
from cumulus.functions.dates import (
    UPDATE_DATE_FORMATS,
    day_label,
    observed_date,
    quarter_index,
    update_date,
)
from cumulus.functions.parse import (
    coordinate,
    code_or_zero,
    float_text_long,
    measure_long,
    try_long,
)
from cumulus.functions.text import normalise_country, normalise_region, split_quoted

__all__ = [
    "UPDATE_DATE_FORMATS", "array_text", "code_or_zero", "coordinate", "day_label", "day_value",
    "float_text_long", "measure_long", "normalise_country", "normalise_region", "observed_date",
    "pairwise_growth", "quarter_index", "split_quoted", "try_long", "update_date",
]
