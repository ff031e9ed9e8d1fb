"""Row numbers in file order, from what the scan itself knows.

A row of a file source has a place: its file, and in it either its row index (Parquet) or the block that its
task reads (text formats) and its place in that block. So the rows need not be written to be numbered:
one pass counts rows per file or block, a running sum over those counts gives each one's
first number, and the second pass adds the row's own place. Both passes read the same splits. Were they ever to differ (a
file changed, or the session's split sizes did), a block of the second pass would not be in the first one's
counts, and the query raises.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.operators.shapes import MAX_BROADCAST_ROWS
from cumulus.session import materialize


#: Nodes of an analysed plan that leave a scan's rows where they stand.
_NARROW = ("Project", "Filter", "SubqueryAlias", "Relation", "LogicalRelation")


def _scan_fields(df: DataFrame) -> set[str]:
    """What the scan of files below ``df`` knows of a row; nothing for any other frame."""
    nodes = [re.sub(r"^[\s:+|*-]+", "", line) for line in df._jdf.queryExecution().analyzed().toString().splitlines()]
    if any(n and not n.startswith(_NARROW) for n in nodes):
        return set()
    try:
        return set(df.select("_metadata").schema[0].dataType.names)
    except AnalysisException:
        return set()


def file_ordinal(df: DataFrame, name: str = "id", within_file: bool = False) -> DataFrame:
    """ACTION (one count per file or block; no row is written): append the 0-based, gap-free row number in file
    order: files by path, rows as they stand in the file. With ``within_file`` every file starts at 0.

    ``df`` is a scan of files, with projections and filters at most; a filtered scan numbers the rows that
    pass (by blocks for Parquet too, as a row index counts the others). Any other frame has
    no file order and raises; :func:`dense_ordinal` numbers those.
    """
    known = _scan_fields(df)
    if "file_path" not in known:
        raise ValueError("only a scan of files has a file order")
    filtered = "Filter " in df._jdf.queryExecution().analyzed().toString()
    if "row_index" in known and not filtered:
        place, at = [F.col("_metadata.file_path").alias("_file")], F.col("_metadata.row_index").alias("_at")
    else:
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                 F.col("_metadata.file_block_length").alias("_length"), F.spark_partition_id().alias("_pid")]
        at = F.monotonically_increasing_id().alias("_at")
    keys = ["_file", "_start", "_length", "_pid"][:len(place)]
    counts = df.select(*place, at).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    order = keys[:2]
    before = (Window.partitionBy("_file").orderBy(*order[1:] or order) if within_file
              else Window.orderBy(*order)).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file or block of the input: a window over their number, not over rows.
    offsets = counts.select(*keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_off"))
    offsets = materialize(offsets, "file-offsets")
    o = F.broadcast(offsets) if offsets.count() <= MAX_BROADCAST_ROWS else offsets
    placed = df.select(*[F.col(f"`{c}`") for c in df.columns], *place, at)
    moved = F.raise_error(F.lit("the files were split otherwise when their rows were counted")).cast("long")
    return placed.join(o, keys, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_at") + F.coalesce("_off", moved)).alias(name))
