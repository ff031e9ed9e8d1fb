"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character n-grams (one to three
characters). Every language has several centroids, from spherical k-means over a bounded
sample of its labelled texts. A text gets the language of the centroid with the
highest cosine and is rejected when its cosine is below a share of the floor that the language has for texts
of its length. A floor is a low quantile of the cosines that sampled texts, and their first words, have with
the centroids of the other sampled texts; so a few odd texts do not set it, and short texts have a lower one.

The document frequencies come from all training texts. Only the sample that the centroids are
fitted on is bounded (``per_language``). Model size: classes x centroids x ``BINS`` floats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

UNKNOWN = "und"
BITS = 14
BINS = 1 << BITS
PER_LANGUAGE = 1000
CLUSTERS = 4
#: The quantile of the cosines that is a floor, and the least number of cosines it is taken from.
QUANTILE, LEAST_COSINES = 0.05, 100
#: Length classes: class i has texts of 2^(i-1) to 2^i - 1 different n-grams.
CLASSES = BITS + 2
#: A text is rejected below this share of the floor of its language and length.
MARGIN = 0.5
MAX_LANGUAGES = 5000
#: Characters of a text counted at a time.
_CHUNK = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the 1- to 3-grams of the whole text, lower-cased; ASCII characters
    that are not letters count as blanks. The text is read in pieces of ``_CHUNK`` characters: an n-gram is counted in the
    piece that its last character lies in."""
    lowered = text.lower()
    total = np.zeros(BINS, dtype=np.int64)
    blank, carried = np.array([0x20], dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    ends = [*range(_CHUNK, len(lowered), _CHUNK), len(lowered)]
    for at, end in zip([0, *ends[:-1]], ends, strict=True):
        c = np.frombuffer(lowered[at:end].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        c[(c < 0x61) | ((c > 0x7A) & (c < 0xAA))] = 0x20
        c = np.concatenate([carried, *([] if at else [blank]), c, *([blank] if end == len(lowered) else [])])
        h = np.zeros(len(c), dtype=np.uint32)
        for n in range(3):
            if len(c) <= n:
                break
            h = (h[:len(c) - n] ^ c[n:]) * _MIX[n]
            h ^= h >> np.uint32(15)
            new = h[max(0, len(carried) - n):]
            total += np.bincount((new * _MIX[0]) >> np.uint32(32 - BITS), minlength=BINS)
        carried = c[-2:]
    bins = np.flatnonzero(total)
    return bins, total[bins]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins, counts = ngram_counts(text)
    weights = ((1 + np.log(counts)) * idf[bins]).astype(np.float32)
    norm = np.sqrt((weights.astype(np.float64) ** 2).sum())
    return bins, (weights / norm if norm else weights).astype(np.float32)


def _frequencies(batches):
    df, n = np.zeros(BINS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            df[ngram_counts(text.as_py())[0]] += 1
            n += 1
    bins = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(bins, -1).astype(np.int32)), pa.array(np.append(df[bins], n))],
                                     names=["bin", "n"])


def _beginnings(text: str):
    """The text, and its first 2, 4, 8 ... characters cut back to whole words where there is a blank."""
    yield text
    for size in range(1, (len(text) - 1).bit_length()):
        first = text[:1 << size].rsplit(maxsplit=1)
        if first and _LETTER.search(first[0]):
            yield first[0]


def _floors(texts, x: np.ndarray, owner: np.ndarray, sums: np.ndarray, idf: np.ndarray) -> list[float]:
    """Per length class a low quantile of the texts' and their beginnings' cosines, each with the centroids as they
    are without the text itself. A class of few cosines takes those of its neighbours in; a language of one text has 0."""
    squares, alone = (sums.astype(np.float64) ** 2).sum(axis=1), np.bincount(owner, minlength=len(sums)) < 2
    found = [[] for _ in range(CLASSES)]
    for row, own, text in zip(x, owner, texts, strict=True):
        norms = squares.copy()
        norms[own] += 1 - 2 * float(row @ sums[own])
        norms = np.sqrt(np.maximum(norms, 1e-12))
        for piece in _beginnings(text):
            bins, weights = _vector(piece, idf)
            cosine = (sums[:, bins] @ weights).astype(np.float64)
            cosine[own] -= float(row[bins] @ weights)
            cosine /= norms
            if alone[own]:
                cosine[own] = 0.0
            found[len(bins).bit_length()].append(float(cosine.max()))
    floors = []
    for i in range(CLASSES):
        reach, pool = 0, found[i]
        while len(pool) < LEAST_COSINES and reach < CLASSES:
            reach += 1
            pool = [c for cosines in found[max(0, i - reach):i + reach + 1] for c in cosines]
        floors.append(float(np.quantile(pool, QUANTILE)))
    return floors


def _clusters(idf: np.ndarray, clusters: int, rounds: int = 12):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_u", "text"])
        x = np.zeros((len(group), BINS), dtype=np.float32)
        for row, text in zip(x, group["text"], strict=True):
            bins, weights = _vector(text, idf)
            row[bins] = weights
        k = min(clusters, len(x))
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)]  # the rows are in the order of a hash
        for _ in range(rounds):
            owner = (x @ centres.T).argmax(axis=1)
            sums = np.stack([x[owner == i].sum(axis=0) if (owner == i).any() else centres[i] for i in range(k)])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * k, "cluster": range(k),
                             "centre": [c.astype(np.float32).tolist() for c in centres],
                             "floors": [_floors(group["text"], x, owner, sums, idf)] * k})

    return fit


@dataclass
class LanguageModel:
    """idf per bin; per centroid its language, centre (unit vector) and the language's floor per length class."""

    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    floors: np.ndarray


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, seed: int = 0) -> LanguageModel:
    """ACTION: learn from the rows with a text and a language.

    Document frequencies are counted over all rows; centroids are fitted per language, one
    task each, on at most ``per_language`` texts chosen by a hash of id and text. Texts without a letter
    teach nothing. An empty table gives a model without languages.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11).cast("double") * F.lit(2.0 ** -53)
    usable = train.select(u.alias("_u"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    df = {r["bin"]: r["n"] for r in usable.select("text").mapInArrow(_frequencies, "bin int, n long")
          .groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0) or 0
    seen = np.zeros(BINS)
    for b, n in df.items():
        seen[b] = n
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    if not counts:
        return LanguageModel(idf, [], np.zeros((0, BINS), np.float32), np.zeros((0, CLASSES)))
    # A share that leaves about twice the sample, then the exact sample: the sort sees few rows.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * per_language + 50) / n))])
    ranked = usable.where(F.col("_u") < F.element_at(share, F.col("lang"))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "text")))
    fitted = ranked.where(F.col("_rank") <= per_language).select("lang", "text", "_u").groupBy("lang").applyInPandas(
        _clusters(idf, clusters), "lang string, cluster int, centre array<float>, floors array<double>").collect()
    fitted.sort(key=lambda r: (r["lang"], r["cluster"]))
    return LanguageModel(idf, [r["lang"] for r in fitted], np.array([r["centre"] for r in fitted], dtype=np.float32),
                         np.array([r["floors"] for r in fitted]))


def _predict(model: LanguageModel, at: int, n_kept: int, margin: float):
    across = np.ascontiguousarray(model.centres.T)

    def run(batches):
        for batch in batches:
            langs, scores, rejected = [], [], []
            for value in batch.column(at):
                text = value.as_py()
                best = None
                if text is not None and model.langs and _LETTER.search(text):
                    bins, weights = _vector(text, model.idf)
                    cosine = weights @ across[bins]
                    best = int(cosine.argmax())
                langs.append(UNKNOWN if best is None else model.langs[best])
                scores.append(0.0 if best is None else min(1.0, max(0.0, float(cosine[best]))))
                rejected.append(best is None or scores[-1] < margin * model.floors[best][len(bins).bit_length()])
            keep = range(n_kept)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())],
                names=[*[batch.schema.names[i] for i in keep], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: LanguageModel, keep=("doc_id",), text_col: str = "text",
            margin: float = MARGIN) -> DataFrame:
    """The ``keep`` columns and, per row, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Reads the whole text and nothing else. A null text, or one without a letter, is ``und`` with score 0 and
    rejected; any other text gets a learned language, and is rejected if its cosine is
    below ``margin`` times its language's floor for its length. Given columns with the names of the three are replaced. A tie goes to
    the language first in code point order. A model without languages rejects all.
    """
    added = ("lang_pred", "score", "rejected")
    keep = [c for c in keep if c not in added]
    at = keep.index(text_col) if text_col in keep else len(keep)  # the text is sent once
    sent = list(dict.fromkeys([*keep, text_col]))
    cols = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    schema = StructType([StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
                        + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    out = cols.mapInArrow(_predict(model, at, len(keep), margin), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *added)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: an id, and not held out."""
    return docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
