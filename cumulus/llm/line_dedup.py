"""Line deduplication: range-partitioned line hashes, and keep bitmaps instead of text.

Every line becomes (128-bit hash of its key, document, position). The rows are
range-partitioned by hash with a secondary sort by document and position, and each
run of one hash is streamed once: it yields the number of documents and the first
occurrence. A salt from the document lets the splitters cut the run of a line that a
third of all documents share into up to ``salts`` parts; the parts' counts (at most
``salts`` rows per line) are added afterwards. Documents get the decision back as a
compressed bitmap; text moves only when the bitmaps are applied.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cumulus.llm.common import partitions, text_key
from cumulus.session import materialize

_LINE = "h1 long, h2 long, doc_id long, doc_key long, pos int, n_lines int"


def _explode_lines(least_chars: int):
    def run(batches):
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("doc_key", pa.int64()),
                            ("pos", pa.int32()), ("n_lines", pa.int32())])
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys, texts = batch.columns
            for at in range(0, batch.num_rows, 256):
                docs, pos, count, blob = [], [], [], bytearray()
                for i in range(at, min(at + 256, batch.num_rows)):
                    lines = (texts[i].as_buffer() or b"") if texts[i].is_valid else b""
                    lines = bytes(lines).split(b"\n")
                    for p, line in enumerate(lines):
                        key = line.strip().lower()  # bytes: ASCII white space and A-Z only
                        if key and (least_chars <= 1 or len(key.decode()) >= least_chars):
                            blob += digest(key)
                            docs.append(i)
                            pos.append(p)
                            count.append(len(lines))
                hashes = np.frombuffer(bytes(blob), dtype="<i8").reshape(-1, 2)
                take = pa.array(docs, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), ids.take(take), keys.take(take),
                     pa.array(pos, pa.int32()), pa.array(count, pa.int32())], schema=schema)

    return run


def _bitmap(batches):
    schema = pa.schema([("_doc_id", pa.int64()), ("_doc_key", pa.int64()), ("keep_bitmap", pa.binary())])
    for batch in batches:
        out = []
        for dropped, n in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, dtype=bool)
            keep[dropped.values.to_numpy()] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], schema=schema)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                 min_chars: int = 1, keep: str = "none", salts: int | None = None) -> DataFrame:
    """ACTION (writes one narrow row per line): which lines of which documents stay.

    A line's key is the line without ASCII white space at both ends, A-Z in lower
    case; keys shorter than ``min_chars`` code points always stay. Lines whose key is found
    in ``min_docs`` documents or more go: all of them (``keep="none"``), or all but
    the first by id and position (``keep="first"``).

    Returns one row for each document that loses a line: ``_doc_id``, ``_doc_key``
    (hash of the text; both together name a document, so ids may repeat) and
    ``keep_bitmap`` (zlib-compressed bits, one per line). Rows that repeat both id and text
    count as one document. Null or empty texts are one empty line, which stays.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    n = partitions(docs.sparkSession)
    salts = salts or max(64, 2 * n)
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("doc_key"),
                        F.col(text_col).cast("string").alias("text")).mapInArrow(_explode_lines(min_chars), _LINE)
    salt = F.pmod(F.xxhash64("doc_id", "doc_key"), F.lit(salts)).cast("int")
    placed = lines.withColumn("salt", salt).repartitionByRange(n, "h1", "h2", "salt")
    # The window's keys are the splitters', so it sorts in place: hash, then document and position.
    run = Window.partitionBy("h1", "h2", "salt")
    stream = run.orderBy("doc_id", "doc_key", "pos")
    same = F.lag(F.struct("doc_id", "doc_key")).over(stream).eqNullSafe(F.struct("doc_id", "doc_key"))
    runs = materialize(placed.select(
        "*", F.row_number().over(stream).alias("rank"), F.when(same, 0).otherwise(1).alias("_new"),
    ).select("h1", "h2", "salt", "doc_id", "doc_key", "pos", "n_lines", "rank",
             F.sum("_new").over(run).alias("docs")), "line-runs")
    heads = runs.where("rank = 1")
    common = heads.groupBy("h1", "h2").agg(
        F.sum("docs").alias("_docs"), F.min(F.struct("doc_id", "doc_key", "pos")).alias("_first")
    ).where(F.col("_docs") >= min_docs)
    parts = heads.select("h1", "h2", "salt").join(common, ["h1", "h2"])
    gone = runs.join(parts, ["h1", "h2", "salt"])
    if keep == "first":
        gone = gone.where(~F.col("_first").eqNullSafe(F.struct("doc_id", "doc_key", "pos")))
    return gone.groupBy("doc_id", "doc_key").agg(F.collect_list("pos"), F.max("n_lines")).mapInArrow(
        _bitmap, "_doc_id long, _doc_key long, keep_bitmap binary")


def _apply(text_at: int, bitmap_at: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, totals, drops = [], [], []
                for text, bits in zip(part.column(text_at), part.column(bitmap_at), strict=True):
                    data = bytes(text.as_buffer()) if text.is_valid else b""
                    lines = data.split(b"\n")
                    totals.append(len(lines))
                    if not bits.is_valid:
                        texts.append(data if text.is_valid else None)
                        drops.append(0)
                        continue
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits.as_py()), np.uint8), count=len(lines))
                    kept = [line for line, k in zip(lines, keep, strict=True) if k]
                    texts.append(b"\n".join(kept))
                    drops.append(len(lines) - len(kept))
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else part.column(i)
                           for i in range(bitmap_at)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(totals, pa.int64()), pa.array(drops, pa.int64())],
                    names=[*part.schema.names[:bitmap_at], "n_lines", "n_dropped"])

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines joined by line feeds, and ``n_lines`` and ``n_dropped`` (longs).

    A document without a bitmap is unchanged (a null text stays null). Other columns pass
    through; given columns named ``n_lines`` or ``n_dropped`` are replaced. One shuffle of the documents.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Numbered names cannot clash with those of the join.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], text_key(text_col).alias("_key"))
    doc_id = F.col(f"c{names.index(id_col)}").cast("long")
    joined = rows.join(bitmaps, doc_id.eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_doc_key")), "left").select(
        *[f"c{i}" for i in range(len(names))], "keep_bitmap")
    schema = StructType([StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
                        + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    out = joined.mapInArrow(_apply(names.index(text_col), len(names)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_dropped")
