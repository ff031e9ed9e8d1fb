"""SimHash near-duplicates: covering locality-sensitive hashing.

A table keeps the fingerprint bits of one mask. Every bit gets a vector of radius + 1 bits, and
the mask of a vector v keeps the bits whose vector has an odd number of ones in common with v. Up to ``radius``
differing bits span at most ``radius`` dimensions of radius + 1, so some v other than zero is orthogonal to all
of them: its table drops every differing bit, and the pair shares a bucket there. No pair within
the radius is missed, whatever the fingerprints.

Equal fingerprints are one node. A bucket of more than ``LIMIT`` nodes, where a mask holds little
apart, is covered once more by the same construction over the bits its mask dropped (some 30 of 64, then some
14), which bounds every bucket by the bits left free. Buckets are compared in blocks inside a task;
a large one returns a spanning set of its links, not its pairs.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulus.llm.common import partitions
from cumulus.llm.near_dedup import components
from cumulus.session import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Nodes in a bucket up to which it is compared as it is.
LIMIT = 1024
#: Nodes in a bucket up to which its links are returned as they are.
SMALL = 16
#: Bytes of text handled at a time.
_CHUNK = 1 << 20
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _pieces(data: bytes):
    """The text in pieces that end at white space."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + _CHUNK)
        end = space.start() if space else len(data)
        yield data[at:end]
        at = end


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    """How many of the shingles' hashes have each bit, most significant first."""
    of = functools.partial(xxhash.xxh64_digest, seed=SEED)
    raw = np.frombuffer(b"".join(map(of, shingles)), dtype=np.uint8).reshape(-1, 8)
    seen = np.bincount((raw + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BIT).ravel()


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """SimHash of a text's runs of k words, repeats included, as an unsigned number: a bit is 1 if it
    is in more than half the hashes. A shorter text is one run; without words it is 0."""
    tail: list[bytes] = []
    n, counts = 0, np.zeros(64, dtype=np.int64)
    for piece in _pieces(text):
        words = tail + piece.lower().split()
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-1]])[:len(words) - k + 1]
            runs = [joined[s:e] for s, e in zip(starts.tolist(), (ends[k - 1:] - 1).tolist(), strict=True)]
            n += len(runs)
            counts += _bit_counts(runs)
        tail = words[len(words) - k + 1:] if len(words) >= k else words
    if not n and tail:
        n, counts = 1, _bit_counts([b" ".join(tail)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprint_rows(k: int):
    def run(batches):
        for batch in batches:
            marks = [fingerprint(bytes(t.as_buffer()), k) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, dtype=np.uint64).view(np.int64))],
                                             names=["doc_id", "mark"])

    return run


def covering_masks(radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks over the bits of ``free``: two values that agree outside ``free`` and differ in at most
    ``radius`` bits agree in all bits of some mask."""
    vectors = (1 << (radius + 1)) - 1
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for i, b in enumerate(bits) if ((1 + i % vectors) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tables(rows: DataFrame, masks: Column | list[int], name: str) -> DataFrame:
    """A row per table: ``name`` is its number, ``name``_key the kept bits."""
    listed = masks if isinstance(masks, Column) else F.array(*[F.lit(_signed(m)) for m in masks])
    spread = rows.select("*", F.posexplode(listed).alias(name, "_mask"))
    return spread.withColumn(f"{name}_key", F.col("mark").bitwiseAND(F.col("_mask"))).drop("_mask")


def _members(rows: DataFrame, bucket: list[str], label: str) -> DataFrame:
    """ACTION: the rows of buckets of two nodes or more, with the bucket's ``size``."""
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(rows.join(sizes, bucket), label)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _links(radius: int, n_keys: int, outer: list[int], inner: list[list[int]] | None):
    """Links within buckets: rows (bucket columns, mark), sorted by bucket. A pair is linked in the first table only where it meets."""
    first_of = np.array(outer, dtype=np.uint64)
    inner_of = np.array(inner, dtype=np.uint64) if inner else None

    def near(x, y, table, table2):
        apart = x ^ y
        ok = np.bitwise_count(apart) <= radius
        at = np.flatnonzero(ok)
        if len(at):
            d = apart[at]
            keep = ((d[:, None] & first_of) == 0).argmax(axis=1) == table[at]
            if inner_of is not None:
                keep &= ((d[:, None] & inner_of[table[at]]) == 0).argmax(axis=1) == table2[at]
            at = at[keep]
        return at

    def compare(keys, marks):
        table = keys[0]
        table2 = keys[2] if inner_of is not None else table
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate([begin, [len(marks)]]))
        run = np.cumsum(new) - 1
        left, right = [], []
        small = size[run] <= SMALL
        for step in range(1, SMALL):
            i = np.flatnonzero(small[:-step] & (run[step:] == run[:-step]))
            if not len(i):
                break
            i = i[near(marks[i], marks[i + step], table[i], table2[i])]
            left.append(marks[i])
            right.append(marks[i + step])
        for s, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            own = marks[s:s + n]
            rows = max(1, (1 << 20) // n)
            a, b = [], []
            for at in range(0, n, rows):
                i, j = np.nonzero(np.bitwise_count(own[at:at + rows, None] ^ own[None, :]) <= radius)
                i, j = i[j > i + at] + at, j[j > i + at]
                a.append(i)
                b.append(j)
            i, j = np.concatenate(a), np.concatenate(b)
            label = _spanning(n, i, j)
            other = np.flatnonzero(label != np.arange(n))
            left.append(own[label[other]])
            right.append(own[other])
        return left, right

    def run(batches):
        held = None
        names = ["a", "b"]

        def emit(block):
            left, right = compare(block[:-1], block[-1].view(np.uint64))
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                for s in range(0, len(a), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s:s + (1 << 16)].view(np.int64)) for x in (a, b)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            block = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_keys + 1)]
            if held is not None:
                block = [np.concatenate([h, c]) for h, c in zip(held, block, strict=True)]
            # The last run may go on in the next batch.
            same = np.all([k == k[-1] for k in block[:-1]], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [c[cut:] for c in block]
            if cut:
                yield from emit([c[:cut] for c in block])
        if held is not None:
            yield from emit(held)

    return run


def _linked(members: DataFrame, bucket: list[str], run) -> DataFrame:
    n = partitions(members.sparkSession)
    return members.select(*bucket, "mark").repartition(n, *bucket).sortWithinPartitions(*bucket).mapInArrow(run, "a long, b long")


def covering_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """ACTION: links (a, b) that connect all of the distinct 64-bit values ``mark`` that differ in at most ``radius`` bits:
    every such pair is linked, directly or through others of its bucket that are."""
    outer = covering_masks(radius)
    inner = [covering_masks(radius, ((1 << 64) - 1) ^ m) for m in outer]
    one = ["t", "t_key"]
    members = _members(_tables(marks.select("mark"), outer, "t"), one, "simhash-buckets")
    few = _linked(members.where(F.col("size") <= LIMIT), one, _links(radius, 2, outer, None))
    large = members.where(F.col("size") > LIMIT).select(*one, "mark")
    if large.limit(1).count() == 0:
        return few
    of_table = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in inner])
    two = [*one, "u", "u_key"]
    again = _members(_tables(large, F.get(of_table, F.col("t")), "u"), two, "simhash-buckets")
    return few.union(_linked(again, two, _links(radius, 4, outer, inner)))


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                       radius: int = RADIUS) -> DataFrame:
    """ACTION: per input row the id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest id
    that links of ``radius`` or fewer differing bits reach, its own included.

    Words are runs without ASCII white space, A-Z lower-cased, whole texts are read in pieces. Texts that are null or without words
    have fingerprint zero and are linked like any other. Rows that repeat an id are rows of their own, linked
    by their texts; a null id is passed over as a component's id unless the component has no other.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    written = materialize(rows.mapInArrow(_fingerprint_rows(k), "doc_id long, mark long"), "simhash-marks")
    marks = materialize(written.groupBy("mark").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(covering_links(marks, radius)).select(F.col("node").alias("mark"), "component")
    of_mark = marks.join(found, "mark", "left").select("mark", "least", F.coalesce("component", "mark").alias("component"))
    named = of_mark.join(of_mark.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("mark", "component_id")
    return written.join(named, "mark").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
