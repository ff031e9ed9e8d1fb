"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines
#: (space, tab, line feed, vertical tab, form feed, carriage return). Python's
#: ``bytes.split()`` and ``bytes.strip()`` use exactly this set.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle partition count, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def uniform(*parts: Column | int | str) -> Column:
    """A repeatable pseudo-random double in [0, 1) from the hash of ``parts``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0 ** -53)


def text_key(text: str = "text") -> Column:
    """64-bit hash of a text; with ``doc_id`` it names a row apart from rows that repeat its id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner waits for the driver's
    garbage collection, which a driver with little to do may put off for half an hour. For use
    after a large table has been written and what led to it is no longer needed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch to a Python task, where the session has Spark's default of 10,000.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Send this library's modules to the executors, once per application (Spark's own file
    distribution), so that functions run there can import them without an installation. Set the session's Arrow
    batches to ``BATCH_ROWS`` rows unless it has a setting of its own: 10,000 whole texts are held several times
    over, in the executor and in its Python workers."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_cumulus_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="cumulus-ship-"), "cumulus.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._cumulus_shipped = True


def shipped(query):
    """A query or stage (spark, ...) that first sends the modules its tasks import."""
    @functools.wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
