"""Packing documents into sequences: shortest-pack-first over the length histogram.

Documents are tokenised where they lie and cut every ``max_len`` ids. The driver gets
only the histogram of piece lengths (at most ``max_len`` rows) and packs it: lengths
are placed longest first, each into the packs with the most room, by updating
counts of packing patterns. A piece then finds its sequence from its length and its
rank among the pieces of that length, so no text or ids are moved.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.common import SPACES, partitions
from cumulus.session import materialize

MAX_LEN = 2048
END_ID = 1
#: Pieces that a worker remembers the ids of until it starts anew.
CACHED_PIECES = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed value: the tokenizer's own pattern, by which it splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters up to here that are their own composed form and have a lower case of one character among them.
_LATIN = [c for c in map(chr, range(0x21, 0x180)) if not 0x7F <= ord(c) <= 0xA0 and c not in "\u0130\u0149"]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind)


_SIMPLE = re.compile(f"[{SPACES}{re.escape(''.join(_LATIN))}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{SPACES}{_class('L')}{_class('N')}]+")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(others)) for b in range(256)]


class _TokenIds(dict):
    """Little-endian 32-bit ids per piece of a text, remembered.

    A tokenizer with the pattern above drops white space, and its merges stay within a piece, so a text of
    simple characters is split here and each new piece goes to the model alone. Words
    with other characters, and other tokenizers' texts, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge, self.letters = tokenizer.encode, tokenizer.model.tokenize, _byte_letters()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        steps = (given.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [n.get("type") for n in (given.get("normalizer") or {}).get("normalizers", [])]
        self.by_piece = (normal == ["NFC", "Replace", "Lowercase"] and (steps[0].get("pattern") or {}).get("Regex") == SPLIT
                         and [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space"))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        letters = self.letters
        ids = np.array([t.id for t in self.merge("".join([letters[b] for b in piece.encode()]))], dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def simple(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        if not self.by_piece:
            return self.whole(text)
        if "<|" not in text and _SIMPLE.fullmatch(text):
            return self.simple(text)
        return b"".join([self.simple(w) if "<|" not in w and _SIMPLE.fullmatch(w) else self.whole(w)
                         for w in re.split(f"[{SPACES}]+", text)])


_LOADED: dict[str, _TokenIds] = {}


def token_bytes(text: bytes, path: str, end_id: int) -> bytes:
    """The text's ids and the closing id, four little-endian bytes each."""
    if path not in _LOADED:
        _LOADED[path] = _TokenIds(path)
    return _LOADED[path].ids(text.decode()) + int(end_id).to_bytes(4, "little")


def _cut(path: str, end_id: int, max_len: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for i, text in enumerate(texts):
                data = token_bytes(bytes(text.as_buffer()) if text.is_valid else b"", path, end_id)
                n = len(data) // 4
                for start in range(0, n, max_len):
                    piece = data[4 * start:4 * (start + max_len)]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. Null texts count as empty:
    their only id is ``end_id``. Narrow; the whole text is tokenised."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _cut(tokenizer or default_tokenizer(), end_id, max_len),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: (number of packs, [(length, times), ...]) per pattern.

    A length's pieces go to the packs with the most room, and only when none has room
    to new packs, as many to a pack as it holds. A pattern is split when only some of its packs get
    a piece, so each length adds at most three patterns; a pattern has at most
    about sqrt(2 * max_len) lengths.
    """
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)

    def put(packs: int, pattern: tuple[tuple[int, int], ...], room: int, length: int, times: int) -> None:
        if packs and times:
            if pattern and pattern[-1][0] == length:
                pattern, times_before = pattern[:-1], pattern[-1][1]
                by_room[room - length * times].append((packs, (*pattern, (length, times_before + times))))
            else:
                by_room[room - length * times].append((packs, (*pattern, (length, times))))

    for length in sorted(counts, reverse=True):
        left, room = counts[length], max(by_room, default=0)
        while left and room >= length:
            if not by_room.get(room):
                by_room.pop(room, None)
                room -= 1
                continue
            packs, pattern = by_room[room].pop()
            used = min(packs, left)
            if used < packs:
                by_room[room].append((packs - used, pattern))
            put(used, pattern, room, length, 1)
            left -= used
        each = max_len // length
        put(left // each, (), max_len, length, each)
        put(int(left % each > 0), (), max_len, length, left % each)
    return [(packs, list(pattern)) for room in sorted(by_room) for packs, pattern in by_room[room]]


def _slots(patterns) -> dict[int, np.ndarray]:
    """Per length an array of rows (first rank, times per pack, first sequence, offset), by rank."""
    at: dict[int, int] = defaultdict(int)
    slots: dict[int, list] = defaultdict(list)
    sequence = 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            slots[length].append((at[length], times, sequence, offset))
            at[length] += packs * times
            offset += length * times
        sequence += packs
    return {length: np.array(rows, dtype=np.int64) for length, rows in slots.items()}


def _place(slots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                rows = slots[int(length)]
                slot = rows[np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1]
                beyond = ranks[mine] - slot[:, 0]
                sequence[mine] = slot[:, 2] + beyond // slot[:, 1]
                offset[mine] = slot[:, 3] + beyond % slot[:, 1] * length
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, max_len: int = MAX_LEN, salts: int | None = None) -> DataFrame:
    """ACTION (writes the narrow pieces): ``pieces`` with ``sequence_id`` and ``offset``.

    Every piece lies in one sequence; a sequence's pieces lie one after another from offset 0.
    Rows that repeat are packed as often as they occur; no rows in give no rows out. The
    ranks within one length, however common, come from counts per salt.
    """
    if not {"doc_id", "start", "length", "ids_crc32", "doc_tokens"} <= set(pieces.columns):
        raise ValueError("pieces come from token_pieces")
    salts = salts or max(128, 2 * partitions(pieces.sparkSession))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    written = materialize(pieces.withColumn("_salt", salt), "pieces")
    counted = written.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if max(histogram, default=0) > max_len:
        raise ValueError("a piece is longer than a sequence")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = written.withColumn("_at", F.row_number().over(within)).join(first, ["length", "_salt"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_at") - 1).alias("_rank"))
    return ranked.mapInArrow(
        _place(_slots(pack_histogram(histogram, max_len))),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """ACTION: :func:`token_pieces`, then :func:`pack`."""
    return pack(token_pieces(docs, id_col, text_col, tokenizer, end_id, max_len), max_len)
