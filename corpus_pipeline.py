"""The corpus pipeline: STAGES over the documents table, each stage one training-data operator.

``run`` applies them in order; every stage reads what its predecessor wrote. All but the last
return the columns of documents, ``n_chars`` brought up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.llm import language_id
from cumulus.llm.common import shipped, table, text_key
from cumulus.llm.line_dedup import apply_bitmaps, line_bitmaps
from cumulus.llm.mixing import mix, mixed_documents, word_count
from cumulus.llm.near_dedup import one_of_each
from cumulus.llm.packing import pack_documents
from cumulus.session import materialize, release_frames, releasing

#: Near duplicates: words per shingle and similarity in percent.
SHINGLE, PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that the stages work on, and every given column but the text once more in the struct ``given``: an
    operator's own columns cannot touch those, whatever they are called."""
    return docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("given"))


def _given(docs: DataFrame, rows: DataFrame, new_text: bool = False) -> DataFrame:
    """The columns of ``docs`` from ``rows``, the length too brought up to date with ``new_text``."""
    new = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast("long")} if new_text else {})
    return rows.select(*[new.get(c, F.col("given")[c]).alias(c) for c in docs.columns])


@shipped
def identify_language(spark, docs, sf_dir):
    """Documents that the language model rejects go: null texts, texts without a letter, and texts
    whose cosine is below the floor of their language and length by a margin. The others stay as they are, with all
    given columns, also those called like the model's."""
    model = language_id.fit(language_id.train_rows(docs))
    judged = language_id.predict(_packed(docs), model, keep=["given", "text"])
    return _given(docs, judged.where(~F.col("rejected")))


@shipped
def drop_common_lines(spark, docs, sf_dir):
    """Lines found in ten documents or more go from every text; all documents and their other columns stay."""
    rows = _packed(docs).select("doc_id", "text", "given")
    return _given(docs, apply_bitmaps(rows, line_bitmaps(rows, min_docs=10, min_chars=1)), new_text=True)


@shipped
def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each component of near duplicates stays, the one with the smallest id, also where ids or
    rows repeat or ids are null; texts without words all stay."""
    return one_of_each(docs, k=SHINGLE, percent=PERCENT)


@shipped
def mix_sources(spark, docs, sf_dir):
    """Every source takes its target share: documents are left out or repeated, at most three times, with
    their other columns as they are."""
    rows = _packed(docs).select("doc_id", "text", "source", "given")
    return _given(docs, mixed_documents(mix(rows, ["doc_id", text_key()], size=word_count())), new_text=True)


@shipped
def pack_sequences(spark, docs, sf_dir):
    """All documents, and repeats, in sequences of at most 2048 ids: one row per piece."""
    return pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learning, sketches and packing are not expressible in SQL; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir) -> DataFrame:
    """All stages over the documents table; every result but the last is written and read again. What a stage wrote
    for itself, and the result that it read, are deleted as soon as its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with releasing(spark, this_thread=True) as kept:
            done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.lower().replace(' ', '-')}")
            kept.append(done)
        release_frames(spark, docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
