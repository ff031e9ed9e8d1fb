"""Substring deduplication: repeated-phrase automata.

1. Every window of ``window`` words chooses one phrase of ``PHRASE`` words inside it (the one with the least hash), so equal
   windows choose equal phrases. The windows in a row that choose the same phrase are a stretch. Stretches
   are told apart by hashes only: those that recur whole point back to an earlier one; where a phrase has stretches
   of several kinds (at the ends of a passage), the first of each kind are compared window by window.
   Pointers that continue each other make a passage: a run of words here, and the place of an earlier occurrence.
2. The hashes have only proposed passages so far. Each one's words are now taken from its *earlier* occurrence and sent to the blocks of
   documents that it was proposed for.
3. A block compiles the passages it got into Aho-Corasick automata (pyahocorasick), in shards of bounded size, and streams all
   its documents through them. The hits decide: a passage found word by word at a place after its earlier
   occurrence is removed there, and nothing else is. So no removal rests on a hash, and a document meets
   only the shards of its own block, whatever the size of the whole dictionary.

Documents are dealt into blocks once, in a table stored by block, which the later steps read without moving texts again.
What recurs inside a piece of the scan or a block is settled there, so a phrase that is everywhere
sends one row per piece, not one per occurrence.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.llm.common import free_shuffles, partitions, text_key
from cumulus.llm.words import mix, run_hashes, word_hashes
from cumulus.session import materialize, materialize_by_key, release_frames

WINDOW = 20
PHRASE = 6
#: Bytes of text per block of documents, on average, and per piece of the scan.
BLOCK_BYTES = 4 << 20
#: Bytes of passages compiled into one automaton (a longer passage is a shard of its own).
SHARD_BYTES = 4 << 20
#: Windows of a text looked at at a time.
_CHUNK = 1 << 20
#: Order of a null id.
_NULL_ID = -(1 << 63)

#: A row points back: ``n`` windows from ``start`` of document (d, k) equal those from ``rstart`` of (rd, rk). Without
#: (rd, rk), a stretch (``phrase``, ``kind``) or window (``phrase``) that may still have an earlier equal.
_NAMES = ["d", "k", "start", "n", "phrase", "kind", "rd", "rk", "rstart"]
_DDL = "d long, k long, start int, n int, phrase long, kind long, rd long, rk long, rstart int"


def chosen_phrases(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash per phrase, and per window the position of the phrase it chooses (leftmost least hash)."""
    phrases = run_hashes(words, PHRASE)
    inside = window - PHRASE + 1
    if len(phrases) < inside:
        return phrases, np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(phrases, inside)
    return phrases, view.argmin(axis=1) + np.arange(len(view))


def _stretches(words: np.ndarray, window: int):
    """(phrase, kind, start, n) arrays of the stretches of a text, a chunk of windows at a time."""
    total = len(words) - window + 1
    for a in range(0, total, _CHUNK):
        part = words[a:min(total, a + _CHUNK) + window - 1]
        phrases, chosen = chosen_phrases(part, window)
        new = np.concatenate([[True], chosen[1:] != chosen[:-1]])
        begin = np.flatnonzero(new)
        place = (np.arange(len(chosen)) - begin[np.cumsum(new) - 1]).astype(np.uint64)
        kinds = np.add.reduceat(mix(run_hashes(part, window) + place * np.uint64(0x9E3779B97F4A7C15)), begin)
        yield (phrases[chosen[begin]].view(np.int64), kinds.view(np.int64), begin + a,
               np.diff(np.concatenate([begin, [len(chosen)]])))


def _batch(columns, pointed: np.ndarray) -> pa.RecordBatch:
    """Rows of _NAMES; where ``pointed`` is false the place pointed to is null, where it is true phrase and kind are."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    masks = [None] * 4 + [pointed] * 2 + [~pointed] * 3
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t, mask=m) for c, t, m in zip(columns, types, masks, strict=True)],
                                      names=_NAMES)


def _settled_here(docs: list[tuple[int, int]], doc: np.ndarray, start: np.ndarray, n: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
    """Rows sorted by keys and place: the first of equal keys stays open, the later ones point to it.
    ``docs`` is in order; repeated rows of one document are given once."""
    order = np.lexsort((start, doc, *reversed(keys)))
    doc, start, n, keys = doc[order], start[order], n[order], [k[order] for k in keys]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    d, k = (np.array([x[i] for x in docs], dtype=np.int64) for i in (0, 1))
    kind = keys[1] if len(keys) > 1 else np.zeros_like(keys[0])
    return _batch([d[doc], k[doc], start, n, keys[0], kind, d[doc[first]], k[doc[first]], start[first]], ~new)


def _anchor_rows(window: int):
    """Stretches of the documents (d, k, text), settled within pieces of BLOCK_BYTES."""
    def settle(texts: dict[tuple[int, int], bytes]):
        docs = sorted(texts)
        found = [(i, *part) for i, key in enumerate(docs) for part in _stretches(word_hashes(texts[key]), window)]
        if found:
            doc = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            phrase, kind, start, n = (np.concatenate([f[j] for f in found]) for j in (1, 2, 3, 4))
            yield _settled_here(docs, doc, start, n, phrase, kind)

    def run(batches):
        texts: dict[tuple[int, int], bytes] = {}
        size = 0
        for batch in batches:
            for d, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if text.is_valid:
                    texts[d, k] = bytes(text.as_buffer())
                    size += len(texts[d, k])
                if size >= BLOCK_BYTES:
                    yield from settle(texts)
                    texts, size = {}, 0
        if texts:
            yield from settle(texts)

    return run


def _settle(batches):
    """Open rows sorted by phrase, kind and place: later ones of a kind point to its first; the firsts of a
    phrase of several kinds stay open. State: the first row of the last kind, and whether it is given out."""
    head: list[np.ndarray] | None = None
    given = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        held = head is not None
        if held:
            rows = [np.concatenate([h, r]) for h, r in zip(head, rows, strict=True)]
        d, k, start, n, phrase, kind = rows
        new_phrase = np.concatenate([[True], phrase[1:] != phrase[:-1]])
        new_kind = new_phrase | np.concatenate([[True], kind[1:] != kind[:-1]])
        first = np.maximum.accumulate(np.where(new_kind, np.arange(len(new_kind)), 0))
        later = ~new_kind & ((d != d[first]) | (k != k[first]) | (start != start[first]))
        group = np.cumsum(new_phrase) - 1
        kinds = np.bincount(group, weights=new_kind) + (np.arange(group[-1] + 1) == 0) * given
        open_rows = new_kind & (kinds[group] > 1)
        if held and given:
            open_rows[0] = False
        at = np.flatnonzero(later | open_rows)
        if len(at):
            f = first[at]
            yield _batch([d[at], k[at], start[at], n[at], phrase[at], kind[at], d[f], k[f], start[f]], later[at])
        head = [r[first[-1]:first[-1] + 1] for r in rows]
        given = bool(kinds[-1] > 1)


def _window_rows(window: int):
    """The windows of a block's open stretches, settled within the block."""
    def run(docs: pa.Table, stretches: pa.Table) -> pa.Table:
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, k, s, n in zip(*[stretches[c].to_pylist() for c in ("d", "k", "start", "n")], strict=True):
            wanted.setdefault((d, k), []).append((s, n))
        texts = {(d, k): bytes(t.as_buffer()) for d, k, t in zip(docs["d"].to_pylist(), docs["k"].to_pylist(), docs["text"], strict=True)
                 if (d, k) in wanted}
        order = sorted(texts)
        doc, start, keys = [], [], []
        for i, key in enumerate(order):
            spans = np.array(sorted(set(wanted[key])), dtype=np.int64)
            ends = np.cumsum(spans[:, 1])
            at = np.repeat(spans[:, 0], spans[:, 1]) + np.arange(ends[-1]) - np.repeat(ends - spans[:, 1], spans[:, 1])
            doc.append(np.full(len(at), i))
            start.append(at)
            keys.append(run_hashes(word_hashes(texts[key]), window)[at].view(np.int64))
        if not doc:
            return pa.Table.from_batches([], schema=_batch([np.zeros(0, np.int64)] * 9, np.zeros(0, bool)).schema)
        at = np.concatenate(start)
        return pa.Table.from_batches([_settled_here(order, np.concatenate(doc), at, np.ones_like(at), np.concatenate(keys))])

    return run


def _passages(batches):
    """Pointers sorted by document, start and place pointed to: those that continue each other as one (d, k, rd, rk, rstart, n)."""
    names = ["d", "k", "rd", "rk", "rstart", "n"]
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
        d, k, start, n, rd, rk, rstart = rows
        goes_on = ((start[1:] == start[:-1] + n[:-1]) & (rstart[1:] - start[1:] == rstart[:-1] - start[:-1])
                   & np.all([c[1:] == c[:-1] for c in (d, k, rd, rk)], axis=0))
        begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        length = np.add.reduceat(n, begin)
        held = [c[begin[-1]:begin[-1] + 1] for c in rows]
        held[3] = length[-1:]
        done = begin[:-1]
        if len(done):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (d[done], k[done], rd[done], rk[done], rstart[done], length[:-1])], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[i]) for i in (0, 1, 4, 5, 6, 3)], names=names)


def _passage_words(window: int):
    """The words of the passages that point into a block's documents."""
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, k, s, n in zip(*[asked[c].to_pylist() for c in ("rd", "rk", "rstart", "n")], strict=True):
            wanted.setdefault((d, k), []).append((s, n))
        out: list[tuple] = []
        for d, k, text in zip(docs["d"].to_pylist(), docs["k"].to_pylist(), docs["text"], strict=True):
            spans = wanted.pop((d, k), None)
            if spans:
                words = bytes(text.as_buffer()).split()
                out += [(d, k, s, n, b" ".join(words[s:s + n + window - 1]).decode()) for s, n in spans]
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                    names=["rd", "rk", "rstart", "n", "words"])

    return run


def _shards(passages: pa.Table):
    """Automata over a block's passages: (automaton, their lengths in bytes, earlier places), SHARD_BYTES of words each."""
    rows = sorted(zip(*[passages[c].to_pylist() for c in ("rd", "rk", "rstart")], passages["words"], strict=True), key=lambda r: r[:3])
    at = 0
    while at < len(rows):
        shard = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        lengths, places, size = [], [], 0
        while at < len(rows) and (not size or size < SHARD_BYTES):
            # One character per byte, so places are byte offsets. Equal words found earlier keep their place.
            words = f" {bytes(rows[at][3].as_buffer()).decode('latin-1')} "
            if words not in shard:
                shard.add_word(words, len(lengths))
                lengths.append(len(words))
                places.append(rows[at][:3])
                size += len(words)
            at += 1
        shard.make_automaton()
        yield shard, np.array(lengths), places


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as sorted disjoint ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[first], reach[np.concatenate([first[1:], [True]])]


def _removed(docs: pa.Table, passages: pa.Table) -> pa.Table:
    """Streams the documents of a block through its automata and removes what they find after its earlier occurrence."""
    keys = list(zip(docs["d"].to_pylist(), docs["k"].to_pylist(), strict=True))
    plain = [b" ".join(bytes(t.as_buffer()).split()) if t.is_valid else b"" for t in docs["text"]]
    spans: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in plain]
    for shard, lengths, places in _shards(passages):
        for i, joined in enumerate(plain):
            hits = list(shard.iter(f" {joined.decode('latin-1')} "))
            if not hits:
                continue
            last, which = np.array(hits).T
            # A word starts one byte after a space; the text itself starts after the first one.
            spaces = np.concatenate([[0], np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20) + 1])
            start = np.searchsorted(spaces, last - lengths[which] + 1)
            end = np.searchsorted(spaces, last)
            later = np.fromiter(((*keys[i], s) > places[w] for s, w in zip(start.tolist(), which.tolist(), strict=True)), bool, len(start))
            if later.any():
                spans[i].append(_merge(start[later], end[later]))
    out: list[list] = [[], [], [], []]
    for joined, found in zip(plain, spans, strict=True):
        words = joined.split()
        removed: list[int] = []
        kept = words
        if found:
            starts, ends = _merge(*[np.concatenate(x) for x in zip(*found, strict=True)])
            keep = np.ones(len(words), dtype=bool)
            removed = np.stack([starts, ends], axis=1).ravel().tolist()
            for s, e in zip(removed[::2], removed[1::2], strict=True):
                keep[s:e] = False
            kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        out[0].append(len(words))
        out[1].append(len(words) - len(kept))
        out[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        out[3].append(removed)
    return pa.Table.from_arrays(
        [docs["doc_id"], docs["k"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
         pa.array(out[3], pa.list_(pa.int32()))], names=["doc_id", "doc_key", "n_words", "n_removed", "kept_sha256", "removed"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """ACTION (writes the result, and tables that are deleted as soon as they are read): per row the id,
    ``doc_key`` (hash of the text), ``n_words``, ``n_removed``, ``kept_sha256`` and ``removed``, the word
    ranges [start, end, start, end, ...] covered by a window of ``window`` words that also starts earlier:
    in a document before it by (id, doc_key), or earlier in the same one. Windows are judged on the input.

    Words are runs without ASCII white space, unchanged. Null and empty texts have no words. Rows that
    repeat both id and text are one document: no copy counts as earlier than another. A null id comes first, like the
    least number.
    """
    if window < PHRASE + 4:
        raise ValueError(f"a window has at least {PHRASE + 4} words")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text_col).alias("k"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("d", F.coalesce("doc_id", F.lit(_NULL_ID)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    block = lambda d, k: F.pmod(F.xxhash64(d, k), F.lit(max(n, -(-size // BLOCK_BYTES)))).cast("int")
    pointer = ["d", "k", "start", "n", "rd", "rk", "rstart"]

    def settled(frame: DataFrame) -> DataFrame:
        return frame.where("rd IS NULL").select(*_NAMES[:6]).repartition(n, "phrase").sortWithinPartitions(
            "phrase", "kind", "d", "k", "start").mapInArrow(_settle, _DDL)

    # 1. Pointers, from hashes alone.
    scanned = materialize(rows.select("d", "k", "text").mapInArrow(_anchor_rows(window), _DDL), "repeat-stretches")
    stretches = materialize(settled(scanned).union(scanned.where("rd IS NOT NULL")), "repeat-settled")
    release_frames(spark, scanned)
    free_shuffles(spark)
    dealt = materialize_by_key(rows.withColumn("block", block("d", "k")), "repeat-documents", ["block"], buckets=n)
    free_shuffles(spark)
    several = stretches.where("rd IS NULL").select(block("d", "k").alias("block"), "d", "k", "start", "n")
    windows = materialize(dealt.groupBy("block").cogroup(several.groupBy("block")).applyInArrow(_window_rows(window), _DDL), "repeat-windows")
    free_shuffles(spark)
    pointers = stretches.where("rd IS NOT NULL").select(*pointer).union(windows.where("rd IS NOT NULL").select(*pointer)).union(
        settled(windows).where("rd IS NOT NULL").select(*pointer))
    proposed = materialize(pointers.repartition(n, "d", "k").sortWithinPartitions("d", "k", "start", "rd", "rk", "rstart").mapInArrow(
        _passages, "d long, k long, rd long, rk long, rstart long, n long").select(
        block("d", "k").alias("block"), "rd", "rk", F.col("rstart").cast("int").alias("rstart"), F.col("n").cast("int").alias("n")).distinct(),
        "repeat-proposed")
    release_frames(spark, stretches, windows)
    free_shuffles(spark)

    # 2. Their words, once each from the earlier occurrence, then to every block they were proposed for.
    place = ["rd", "rk", "rstart", "n"]
    asked = proposed.select(*place).distinct().withColumn("block", block("rd", "rk"))
    words = materialize(dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        _passage_words(window), "rd long, rk long, rstart int, n int, words string"), "repeat-passages")
    passages = proposed.join(words, place).select("block", "rd", "rk", "rstart", "words")

    # 3. Automata over them, and all documents through the automata.
    result = materialize(dealt.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(
        _removed, "doc_id long, doc_key long, n_words long, n_removed long, kept_sha256 string, removed array<int>"), "repeat-result")
    release_frames(spark, dealt, proposed, words)
    free_shuffles(spark)
    return result.withColumnRenamed("doc_id", id_col)
