"""Daily growth of a cumulative measure: the first difference (M3, M4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.functions.arrays import pairwise_growth
from cumulus.operators.shapes import dense_ordinal

#: Rows of one window of :func:`growth_vertical_spread`.
WINDOW_ROWS = 65_536


def growth_horizontal(df: DataFrame, which: str) -> DataFrame:
    """Adds ``{which}_growth``: the array of day-over-day differences (first element null).

    A narrow projection with a built-in higher-order function; no shuffle, no UDF.
    """
    return df.withColumn(f"{which}_growth", pairwise_growth(which))


def growth_vertical(df: DataFrame, which: str, partition_cols: Sequence[str] | str,
                    order_col: str = "date") -> DataFrame:
    """Adds ``{which}_growth`` = value minus the previous day's value of the same place.

    One shuffle on the place key (the window's partitioning), none if ``df`` is stored by that key; each window
    partition holds one place's days. Where one key may hold a large share of the rows, take
    :func:`growth_vertical_spread`.
    """
    if isinstance(partition_cols, str):
        partition_cols = [partition_cols]
    w = Window.partitionBy(*partition_cols).orderBy(order_col)
    return df.withColumn(f"{which}_growth", F.col(which) - F.lag(F.col(which), 1).over(w))


def growth_vertical_spread(df: DataFrame, which: str, partition_cols: Sequence[str] | str,
                           order_cols: Sequence[str] | str = "date", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """ACTION (writes the rows once, numbered): :func:`growth_vertical` for keys of any size.

    The rows are range-sorted by key and order and numbered; a hot key is spread over as many ranges as its rows
    fill. ``window_rows`` consecutive numbers form a window, so no window is larger whatever the keys are, and the last
    row of each window is carried to the next one, whose first row needs it. A key's first row is
    told by the key of the row before it. Rows tied on key and order follow the input's order.
    """
    keys = [partition_cols] if isinstance(partition_cols, str) else list(partition_cols)
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    n, w, carried = (_unused(name, df.columns) for name in ("_n", "_w", "_carried"))
    q = lambda c: F.col(f"`{c}`")
    numbered = dense_ordinal(df, n, order_by=[*keys, *order])
    window = F.expr(f"{n} div {window_rows}")
    rows = numbered.withColumns({w: window, carried: F.lit(False)})
    last = numbered.where(q(n) % window_rows == window_rows - 1).withColumns({w: window + 1, carried: F.lit(True)})
    # Of a carried row only the key and the value are looked at.
    used = {*keys, which, n, w, carried}
    lean = last.select(*[q(c) if c in used else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    over = Window.partitionBy(w).orderBy(n)
    same = F.lag(q(w), 1).over(over).isNotNull()
    for k in keys:
        same = same & q(k).eqNullSafe(F.lag(q(k), 1).over(over))
    grown = rows.unionByName(lean).withColumn(f"{which}_growth", F.when(same, q(which) - F.lag(q(which), 1).over(over)))
    return grown.where(~q(carried)).drop(n, w, carried)


def _unused(name: str, columns: Sequence[str]) -> str:
    while name in columns:
        name += "_"
    return name
