"""Secret scans: a random forest removes the false positives of a wide candidate rule.

Every long run of key characters is a candidate, also several in one word. Its features are its length and
character classes, the likelihood of its character transitions under the corpus's own words, the
share of it that dictionary words cover, and hashes of its path and of what stands next to it.
The dictionary and the transitions are counted over all words of all documents. A
Spark ML random forest is trained on labelled findings. Everything runs as DataFrame operations in the JVM.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulus.llm.common import text_key, uniform
from cumulus.session import materialize

#: What may be a key: fixed values of the candidate rule.
KEY_CHARS = r"[A-Za-z0-9+/_\-]"
LEAST = 16
#: Documents a word must occur in to be in the dictionary.
DICTIONARY_DOCS = 3
#: Hash buckets per neighbour or path feature.
BUCKETS = 16
#: Labelled findings per class that the forest is fitted on (a bound on the model's work, not on the scan).
TRAIN_ROWS = 20_000
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0"
_SIDE = len(_ALPHABET) + 1
_WORD = r"[\x20\x09-\x0D]+"


def _symbol(c: Column) -> Column:
    """1-26 for a letter, 27 for a digit, 0 for anything else."""
    return F.instr(F.lit(_ALPHABET), F.when(c.between("0", "9"), "0").otherwise(F.lower(c)))


def _pairs(word: Column) -> Column:
    """Transition indexes of a word; empty below two characters. Linear in the word's length."""
    codes = F.transform(F.split(word, ""), _symbol)
    return F.when(F.length(word) > 1, F.zip_with(
        F.slice(codes, F.lit(1), F.length(word) - 1), F.slice(codes, F.lit(2), F.length(word) - 1),
        lambda a, b: a * _SIDE + b)).otherwise(F.array().cast("array<int>"))


def corpus_words(docs: DataFrame, text_col: str = "text", min_docs: int = DICTIONARY_DOCS) -> DataFrame:
    """ACTION: the dictionary, (word, n_docs): lower-case words of letters only that occur in
    ``min_docs`` documents or more, counted over all documents; partial counts before the shuffle. A run of letters
    of any length is a word, so scripts without blanks have theirs; one letter is none."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))).alias("word"))
    return materialize(words.where(F.length("word") >= 2).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs), "secret-words")


def transition_scores(words: DataFrame) -> list[float]:
    """ACTION: log probability of each character transition within the dictionary's words (a table of
    fixed size on the driver), weighted by their document counts, with one added to every count."""
    counts = {r["p"]: r["n"] for r in words.select("n_docs", F.explode(_pairs(F.col("word"))).alias("p"))
              .groupBy("p").agg(F.sum("n_docs").alias("n")).collect()}
    out = []
    for a in range(_SIDE):
        row = [1 + counts.get(a * _SIDE + b, 0) for b in range(_SIDE)]
        out += [math.log(n / sum(row)) for n in row]
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, doc_key, path, word (index in the text), run (index in the word), candidate,
    before2, before, after (what stands around it, "" at the ends), quoted (stands in quotes itself).

    Every run of at least ``LEAST`` key characters of a word is a candidate. Its neighbours are the pieces of the word
    between runs and those runs; at the word's ends a piece without a letter, digit, = or : gives way to the
    neighbouring word. Null and empty texts have none. Texts without such a run are passed over by one regular
    expression; the others are read whole. The work is linear in a word's length, however many runs it has.
    """
    rule = f"{KEY_CHARS}{{{LEAST},}}"
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("doc_key"),
        (F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")).alias("path"),
        F.col(text_col).alias("_t")).where(F.col("_t").rlike(rule)).withColumn("_w", F.split("_t", _WORD))
    near = rows.select("doc_id", "doc_key", "path", F.explode(F.filter(
        F.transform("_w", lambda w, i: F.struct(
            i.alias("word"), w.alias("w"), F.coalesce(F.get("_w", i - 2), F.lit("")).alias("before2"),
            F.coalesce(F.get("_w", i - 1), F.lit("")).alias("before"), F.coalesce(F.get("_w", i + 1), F.lit("")).alias("after"))),
        lambda s: s["w"].rlike(rule))).alias("_s"))
    # One more piece than runs: the last entry has no run. Zipped, not looked up, so no row carries a whole word.
    runs, pieces = F.regexp_extract_all("_s.w", F.lit(rule), F.lit(0)), F.split("_s.w", rule, -1)
    split = near.select("doc_id", "doc_key", "path", "_s", runs.alias("run"), pieces.alias("left")).select(
        "doc_id", "doc_key", "path", F.col("_s.word").alias("word"), *[F.col(f"_s.{c}").alias(f"_{c}") for c in ("before2", "before", "after")],
        "run", "left", F.slice("left", F.lit(2), F.size("run")).alias("right"), F.concat(F.array(F.lit("")), "run").alias("last"),
        F.slice("run", F.lit(2), F.size("run")).alias("next"))
    each = split.select("doc_id", "doc_key", "path", "word", "_before2", "_before", "_after", F.posexplode(
        F.arrays_zip("run", "left", "right", "last", "next")).alias("_i", "_z")).where("_z.run IS NOT NULL")
    left, right, first, final = F.col("_z.left"), F.col("_z.right"), F.col("_i") == 0, F.col("_z.next").isNull()
    says = r"[\p{L}\p{N}=:]"
    return each.select(
        "doc_id", "doc_key", "path", F.col("word").cast("long").alias("word"), F.col("_i").cast("long").alias("run"),
        F.col("_z.run").alias("candidate"),
        F.when(~first, F.col("_z.last")).when(left.rlike(says), F.col("_before")).otherwise(F.col("_before2")).alias("before2"),
        F.when(first & ~left.rlike(says), F.col("_before")).otherwise(left).alias("before"),
        F.when(final & ~right.rlike(says), F.col("_after")).otherwise(right).alias("after"),
        (left.rlike("[\"'`]\\z") & right.rlike("^[\"'`]")).alias("quoted"))


def features(found: DataFrame, words: DataFrame, transitions: list[float]) -> DataFrame:
    """``found`` with numeric feature columns and their vector ``features``.

    Equal candidates are looked up in the dictionary once, however often they occur.
    """
    size = F.length("candidate")
    share = lambda chars: (size - F.length(F.regexp_replace("candidate", chars, ""))) / size
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    distinct = found.select("candidate").distinct()
    runs = distinct.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"([\p{L}]{3,})"), F.lit(1))).alias("word"))
    covered = runs.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("_covered"))
    table = F.array(*[F.lit(x) for x in transitions])
    pairs = _pairs(F.col("candidate"))
    likely = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + F.get(table, p)) / F.size(pairs)
    named = found.join(covered, "candidate", "left").select(
        "*", size.cast("double").alias("f_length"), share("[0-9]").alias("f_digits"), share("[A-Z]").alias("f_upper"),
        share("[^0-9A-Fa-f]").alias("f_beyond_hex"), (F.length(kinds) / size).alias("f_turns"), likely.alias("f_transitions"),
        (F.coalesce("_covered", F.lit(0)) / size).alias("f_dictionary"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / size).alias("f_distinct"),
        F.col("quoted").cast("double").alias("f_quoted"))
    hashed = []
    for name in ("path", "before2", "before", "after"):
        bucket = F.pmod(F.xxhash64(F.lower(F.regexp_replace(name, r"[^\p{L}=:]", ""))), F.lit(BUCKETS))
        hashed += [(bucket == b).cast("double").alias(f"f_{name}_{b}") for b in range(BUCKETS)]
    wide = named.select("*", *hashed).drop("_covered")
    inputs = [c for c in wide.columns if c.startswith("f_")]
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(wide).drop(*inputs)


def scan(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 8, seed: int = 7, found: DataFrame | None = None) -> DataFrame:
    """ACTION (counts the corpus's words, trains the forest): score every candidate of every document.

    ``found`` are the documents' candidates where the caller has written them already, as for labelling; otherwise
    they are taken here and written. So the documents are read twice: for the words and for the candidates.
    ``labelled`` has the findings' ``candidate``, ``before2``, ``before``, ``after``, ``path``, ``quoted`` (as
    :func:`candidates` gives them) and ``label`` (1 secret, 0 false positive, null: unlabelled, left out). Equal
    findings are fitted once, weighted by their number; at most about ``train_rows`` different ones of each class, chosen
    by hash, and one at least. Returns the candidates' columns
    with ``probability`` and ``is_secret`` (0.5 or more). With labels of one class
    only, every candidate has that class; without any label, probability is 0. Repeated rows give repeated findings.
    """
    words = corpus_words(docs, text_col)
    transitions = transition_scores(words)
    named = ["path", "candidate", "before2", "before", "after", "quoted"]
    known = materialize(labelled.where("label IN (0, 1)").groupBy(*named, F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")).withColumn("_u", uniform(seed, *[F.col(c) for c in named])), "secret-labels")
    counts = {r["label"]: (r["n"], r["least"]) for r in known.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("_u").alias("least")).collect()}
    if found is None:
        found = materialize(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    keep = [c for c in found.columns if c != "doc_key"]
    if len(counts) < 2:
        only = float(next(iter(counts), 0))
        return found.select(*keep, F.lit(only).alias("probability"), F.lit(only >= 0.5).alias("is_secret"))
    # The share of a class, or its finding of the least hash if that is larger.
    below = {c: max(train_rows / n, math.nextafter(least, 2.0)) for c, (n, least) in counts.items()}
    sample = known.where(F.col("_u") < F.when(F.col("label") == 1, F.lit(below[1])).otherwise(F.lit(below[0])))
    ready = materialize(features(sample, words, transitions).select("features", "label", "weight"), "secret-train")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", weightCol="weight").fit(ready)
    scored = forest.transform(features(found, words, transitions))
    probability = vector_to_array("probability")[1]
    return scored.select(*keep, probability.alias("probability"), (probability >= 0.5).alias("is_secret"))
