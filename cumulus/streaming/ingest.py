"""File-stream ingest of observation logs (see package docstring)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from cumulus.operators.cleaning import observation_log
from cumulus.session import scratch_path

# A streaming file source needs its schema up front: the eight text columns of a log file.
LOG_TEXT_SCHEMA = StructType([StructField(n, StringType(), True) for n in (
    "SNo", "ObservationDate", "Province/State", "Country/Region", "Last Update",
    "Confirmed", "Deaths", "Recovered")])


def clean_log_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned log rows from CSV files arriving in ``folder``."""
    reader = (spark.readStream.schema(LOG_TEXT_SCHEMA)
              .option("header", True).option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return observation_log(reader.csv(folder))


def start_log_ingest(spark: SparkSession, folder: str, out_path: str, checkpoint: str | None = None,
                     available_now: bool = True) -> StreamingQuery:
    """Append cleaned rows to a Parquet table at ``out_path``, partitioned by observation date.

    Exactly-once through the file sink's log and the checkpoint (default: a fresh
    folder below ``spark.checkpoint.dir``), so a restarted or failed run resumes.
    """
    cp = checkpoint or scratch_path(spark, "log-ingest-checkpoint")
    writer = (clean_log_stream(spark, folder).writeStream.format("parquet")
              .option("path", out_path).option("checkpointLocation", cp)
              .partitionBy("observed_date").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
