"""Exact deduplication by content sort (DataFrame operations only).

Sampled splitters range-partition the rows by their normalised text, an external
sort within each partition places equal texts next to each other, and the
window operator compares each text in full with its neighbour to close a run.

What the splitters see is bounded: the first ``PREFIX`` characters, a 64-bit
hash that separates texts with a common beginning, and a salt. The salt splits
a group of copies, however large, into at most ``salts`` runs that the splitters
may place in different partitions. Runs are closed on the full text; the runs of
one text (at most ``salts`` rows) are then joined by their SHA-256 digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.common import partitions
from cumulus.session import materialize

PREFIX = 24


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None,
                     keep: str = "smallest", salts: int | None = None) -> DataFrame:
    """ACTION (writes one narrow table): for every row its group of equal texts.

    ``normalise`` maps the text column to the compared column (default: unchanged);
    null counts as the empty text. ``keep`` names the row of a group that stays:
    the one with the ``smallest`` or ``largest`` id.

    Returns one row per input row: the id, ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256`` (of the normalised text). A null id orders below every
    other id and stays only if the whole group has none. Rows that repeat an id
    within a group count in ``group_size``; exactly one of them can be ``kept``.
    No rows in give no rows out; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    n = partitions(spark)
    salts = salts or max(64, 2 * n)
    best = F.max if keep == "largest" else F.min
    first = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()

    text: Column = F.col(text_col)
    text = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id", "_text", F.left("_text", F.lit(PREFIX)).alias("_prefix"), F.xxhash64("_text").alias("_hash"),
        F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"))
    # The splitters' columns are a subset of the window's, so its runs need no second exchange.
    placed = keyed.repartitionByRange(n, "_prefix", "_hash", "_salt")
    run = Window.partitionBy("_prefix", "_hash", "_salt", "_text")
    runs = materialize(placed.select(
        "_id", "_text", "_salt",
        F.row_number().over(run.orderBy(first)).alias("_rank"),
        best("_id").over(run).alias("_best"),
        F.count(F.lit(1)).over(run).alias("_size"),
    ).select("_id", "_salt", "_rank", "_best", "_size", F.sha2("_text", 256).alias("text_sha256")), "exact-runs")

    of_text = runs.where("_rank = 1").groupBy("text_sha256").agg(
        best("_best").alias("keep_id"), F.sum("_size").alias("group_size"), F.count(F.lit(1)).alias("_runs"))
    single = (runs.where("_rank = 1").select("text_sha256", "_salt")
              .join(of_text, "text_sha256"))  # one row per run: at most `salts` of a text
    return runs.join(single, ["text_sha256", "_salt"]).select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_rank") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """ACTION: the kept rows of ``docs``, all columns. Ids must be unique."""
    kept = exact_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_kept_id"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
