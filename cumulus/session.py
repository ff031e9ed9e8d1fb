"""Session helpers: a local session for tests and the bench, and a scratch folder.

On a cluster the caller owns the session. The only thing the library needs
from it is a shared folder for written intermediate tables, which it takes
from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cumulus") -> SparkSession:
    """Session for tests and benchmarks on one machine (UI off, AQE on, UTC, ANSI default)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only when none is configured.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is used as is.
    Only a local session without one gets a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="cumulus-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


#: Scratch tables handed out and not yet released, and the catalogue names of those stored by key.
_HELD: list[str] = []
_TABLES: dict[str, str] = {}
#: The thread that asked for a scratch table.
_THREADS: dict[str, int] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cumulus-scratch/{name}-{uuid.uuid4().hex}"
    _HELD.append(path)
    _THREADS[path] = threading.get_ident()
    return path


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """ACTION: delete scratch tables (all still held, by default) through the file system that
    holds them. Frames that read them can no longer be evaluated."""
    gone = list(_HELD if paths is None else paths)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in gone:
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _HELD:
            _HELD.remove(path)
            _THREADS.pop(path, None)


def release_frames(spark: SparkSession, *frames) -> None:
    """ACTION: delete the scratch tables that ``frames`` read (as :func:`materialize` and
    :func:`materialize_by_key` returned them), when nothing reads them any more."""
    read = _read_by(frames)
    release(spark, [p for p in _HELD if p.rpartition("/")[2] in read])


def _read_by(frames) -> set[str]:
    """The names of the folders whose files ``frames`` read."""
    return {f.rpartition("/")[0].rpartition("/")[2] for df in frames for f in df.inputFiles()}


@contextlib.contextmanager
def releasing(spark: SparkSession, this_thread: bool = False):
    """Delete on leaving the block what was written to scratch inside it; write or collect
    the results before. Yields a list: the scratch tables that the frames appended to it read stay, unless the block raises.
    With ``this_thread``, tables that other threads write meanwhile stay too: for operators, which do not know
    what else the session runs."""
    before, kept = set(_HELD), []
    try:
        yield kept
    except BaseException:
        kept.clear()
        raise
    finally:
        stay = _read_by(kept)
        release(spark, [p for p in _HELD if p not in before and p.rpartition("/")[2] not in stay
                        and not (this_thread and _THREADS[p] != threading.get_ident())])


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme so a path can be used with the local filesystem (tests only)."""
    if uri.startswith("file:"):
        uri = uri[len("file:"):]
        while uri.startswith("//"):
            uri = uri[1:]
    return os.path.abspath(uri)


def materialize(df, name: str):
    """ACTION: write ``df`` as a Parquet table below the shared checkpoint folder and
    return a scan of it.

    Used for small derived tables that many queries read: it computes them once,
    cuts their lineage (a lost executor re-reads the files instead of recomputing
    the scans behind them), and gives later plans real file statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def materialize_by_key(df, name: str, keys, sort=(), buckets: int | None = None):
    """ACTION: like :func:`materialize`, stored co-partitioned: rows are dealt by the hash of ``keys`` into
    ``buckets`` files (the session's shuffle partitions by default), sorted by ``keys`` and ``sort``.

    Tables stored with the same keys and bucket count meet without an exchange, in a join, in
    a grouping of their union, and in a window partitioned by the keys. Spark keeps that
    layout in its catalogue only, so the files get an external table in the default database of the
    session catalogue (:func:`release` drops it with the files). The columns are stored under other names
    and named back on reading: a table's own names carry its name as a qualifier, by which Spark
    takes the keys of two tables for different ones. Column names must differ.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"spark_catalog.default.cumulus_{name.replace('-', '_')}_{path[-32:]}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = {c: f"{re.sub(r'[^A-Za-z0-9]', '_', c)}_{i}" for i, c in enumerate(df.columns)}
    by, order = [stored[k] for k in keys], [stored[k] for k in (*keys, *sort)]
    (df.toDF(*stored.values()).repartition(n, *by).write.format("parquet").option("path", path)
     .bucketBy(n, *by).sortBy(*order).saveAsTable(table))
    _TABLES[path] = table
    held = spark.table(table)
    return held.select(*[held[s].alias(c) for c, s in stored.items()])
