"""Search, mixing, language ID, URL lists, secrets, packing and the pipeline against plain versions."""

import base64
import collections
import datetime as dt
import math
import random
import re
import string
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cumulus import session
from cumulus.llm import language_id, mixing
from cumulus.llm.common import ship
from cumulus.llm.packing import default_tokenizer, pack_documents, pack_histogram, token_bytes
from cumulus.llm.secret_scan import candidates, corpus_words, scan
from cumulus.llm.topk_search import DEPTHS, integer_vectors, nra_block, top_k
from cumulus.llm.url_filter import asof_verdicts, validity_intervals
from cumulus.session import materialize

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", autouse=True)
def modules(spark):
    ship(spark)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op1_topk_search", "op2_substring_dedup", "op5_url_filter", "op8_line_dedup", "op9_near_dedup", "op10_exact_dedup"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, cur.fetchall())


# ---- top-k search -------------------------------------------------------------

def plain_top(ids, vectors, k):
    out = {}
    for q, v in zip(ids, vectors):
        if q % 100 == 0:
            scored = sorted((-int(np.dot(v, w)), i) for i, w in zip(ids, vectors) if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("kind", ["noise", "ties", "sparse"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12))
    if kind == "ties":
        x = rng.integers(-2, 3, size=(700, 5)).astype(float)
        x[100:400] = x[100]
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, [float(c) for c in v], "x") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score string")
    v = integer_vectors(df)
    got = collections.defaultdict(list)
    for r in top_k(v, v.where("vec_id % 100 = 0"), k=10, block_rows=96).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = np.floor(1024 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    assert dict(got) == plain_top(ids, whole, 10)


def test_reading_stops_before_the_lists_end(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(2000, 8)) * 100)
    x[:, 0] += 5000 * (np.arange(2000) < 40)  # forty rows are far ahead in one component
    ids, own = np.arange(2000), np.array([-1, -2])
    queries = np.array([[100.0] + [1.0] * 7, [1.0] * 8])
    read: list[float] = []
    found = {j: list(scores) for j, _, scores in nra_block(x, ids, queries, own, 10, read=read)}
    for j, q in enumerate(queries):
        assert found[j] == sorted((x @ q).tolist(), reverse=True)[:10]
    assert read[0] < 1
    # a floor that no row reaches: nothing is found, at the first depth
    best = (x @ queries[1]).max()
    read = []
    assert [len(s) for _, _, s in nra_block(x, ids, queries[1:], own[1:], 10, np.array([10 * best + 1e5]), read)] == [0] and read == [DEPTHS[0]]
    # a row that just reaches it stays
    assert [list(s) for _, _, s in nra_block(x, ids, queries[1:], own[1:], 10, np.array([best]))] == [[best]]


@pytest.mark.parametrize("block_rows", [7, 64, 1000])
def test_top_k_over_many_blocks(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = [(i, [float(v) for v in np.round(rng.normal(size=6), 2)]) for i in range(500)] + [(100, [0.5] * 6), (300, [0.25] * 3)]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in top_k(v, v.where("vec_id % 20 = 0"), k=5, block_rows=block_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score))
    ints = [(i, np.floor(np.array(x) * 1024).astype(np.int64)) for i, x in rows]
    want = {}
    for i, q in ints:
        if i % 20 == 0:
            scores = sorted((int(q @ w) for j, w in ints if j != i and len(w) == len(q)), reverse=True)[:5]
            want.setdefault(i, []).extend(enumerate(scores, 1))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items() if x}


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (5, [1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (100, [-1.0, 0.5]), (200, []), (201, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = integer_vectors(df)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in top_k(v, v.where("vec_id % 100 = 0"), k=3).collect())
    assert got == [(0, 1, 6), (0, 2, 7), (0, 3, 7), (100, 1, 0), (100, 2, 6), (100, 3, 7), (200, 1, 201)]
    assert top_k(v.limit(0), v.limit(0)).count() == 0
    big = integer_vectors(spark.createDataFrame([(0, [2e13]), (1, [1e13]), (2, [-1e13])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        top_k(big, big).collect()
    mid = integer_vectors(spark.createDataFrame([(0, [5e5, 1.0]), (1, [6e5, 1.0]), (2, [6e5, 2.0])], "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(mid, mid.where("vec_id = 0")).collect()}
    assert got == {(0, 1): (2, 512000000 * 614400000 + 1024 * 2048), (0, 2): (1, 512000000 * 614400000 + 1024 * 1024)}


# ---- mixing -------------------------------------------------------------------

def plain_targets(sizes):
    """Share by weight; stop at three times; share the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        target = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in stopped}, **target}
        stopped |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5000, 10, 10, 300, 2, 900], [0, 50, 7], [9]])
def test_mix_meets_targets(spark, sizes):
    rng = random.Random(4)
    rows, doc = [], 0
    for i, total in enumerate(sizes):
        name = None if i == 1 else f"s{i}"
        while total > 0:
            n = min(total, rng.randint(1, 40))
            rows.append((doc, name, n, "clash", 1))
            total, doc = total - n, doc + 1
        rows.append((doc, name, None, "clash", 1))
        doc += 1
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target string, src int")
    plan = mixing.mix(df, ["doc_id"]).cache()
    got = plan.collect()
    assert sorted(r.doc_id for r in got) == list(range(doc)) and plan.columns.count("target") == 1
    by = collections.defaultdict(int)
    for _, s, n, *_ in rows:
        by[s] += n or 0
    want, taken = plain_targets(by), collections.defaultdict(int)
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == sum(p.words for p in r.placements) <= 3 * r["size"] and len({p.copy for p in r.placements}) == len(r.placements)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in by)
    again = {r.doc_id: r.placements for r in mixing.mix(df.repartition(5), ["doc_id"]).collect()}
    assert again == {r.doc_id: r.placements for r in got}


def test_registered_mix_on_a_given_table(spark):
    got = entry.queries()["op3_mix_sources"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    by, taken = collections.defaultdict(int), collections.defaultdict(int)
    for i, n in size.items():
        by[source[i]] += n
    want = plain_targets(by)
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in by)


def test_split_quotas_are_exact_and_even(spark):
    quotas = spark.createDataFrame([(1, 64), (2, 3), (3, 0), (4, 500)], "src int, n int")
    got = mixing.split_quotas(quotas, 3).collect()
    per = collections.Counter()
    for r in got:
        per[r.src] += r.n
    assert per == {1: 64, 2: 3, 4: 500}
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.n
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 3
    # spread over 16 shards of 750 draws: hypergeometric with 4000 of 12000
    out = mixing.split_quotas(spark.createDataFrame([(1, 4000), (2, 8000)], "src int, n int"), 4, seed=5)
    drawn = [r.n for r in out.where("src = 1").collect()]
    assert len(drawn) == 16 and sum(drawn) == 4000 and 5 < np.std(drawn) < 25  # sqrt(750 * 1/3 * 2/3 * 11250/11999) = 12.5


def test_shares_follow_the_hypergeometric_distribution(spark):
    n = 100_000
    for rest, room, draws in [(40, 20, 11), (60, 10, 50), (1000, 300, 200), (5000, 4990, 100)]:
        share = mixing._share(str(rest), str(room), str(draws), "id, 'test'")
        got = {r.x: r["count"] for r in spark.range(n).select(F.expr(share).alias("x")).groupBy("x").count().collect()}
        log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        lo, hi = max(0, room + draws - rest), min(room, draws)
        want = {k: n * math.exp(log(room, k) + log(rest - room, draws - k) - log(rest, draws)) for k in range(lo, hi + 1)}
        assert lo <= min(got) and max(got) <= hi
        often = [k for k, w in want.items() if w > 5]
        chi2 = sum((got.get(k, 0) - want[k]) ** 2 / want[k] for k in often)
        assert chi2 < len(often) + 5 * (2 * len(often)) ** 0.5


def test_split_of_large_quotas_and_many_sources(spark):
    # a quota of two million draws, and 20,000 sources
    quotas = spark.createDataFrame([(1, 2_000_000)] + [(i, i % 5) for i in range(2, 20_002)], "src int, n int")
    got = mixing.split_quotas(quotas, 5).cache()
    per = {r.src: r.n for r in got.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    assert per == {1: 2_000_000} | {i: i % 5 for i in range(2, 20_002) if i % 5}
    sizes = [r.n for r in got.groupBy("shard").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == 32 and max(sizes) - min(sizes) <= 5
    hot = [r.n for r in got.where("src = 1").collect()]
    assert 20 < np.std(hot) < 70  # sqrt(63750 * 0.98 * 0.02 * 0.97) is some 35
    assert mixing.split_quotas(quotas.limit(0), 5).count() == 0


def test_mix_of_many_sources_in_blocks_of_a_stated_size(spark):
    # 100,000 small sources and one with half of all words; no group of (source, block) is much above a block
    small = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.lpad("id", 6, "0")).alias("source"), (1 + F.col("id") % 19).alias("size"))
    hot = spark.range(100_000, 200_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(10).cast("long").alias("size"))
    plan = mixing.mix(small.union(hot), ["doc_id"], block_words=500).cache()
    totals = plan.groupBy("source").agg(F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).cache()
    assert totals.count() == 100_001
    assert totals.where("abs(taken - target) > 0.5 OR taken > 3 * size").count() == 0
    assert plan.where("taken > 3 * size").count() == 0
    shards = plan.select(F.explode("placements").alias("p")).groupBy("p.shard").agg(F.sum("p.words").alias("words")).collect()
    assert len(shards) == 64 and max(r.words for r in shards) < 1.5 * sum(r.words for r in shards) / 64
    # the hot source is dealt into blocks of about 500 words
    blocks = 100_000 * 10 / 500
    size = F.count(F.lit(1)).alias("n")
    at = F.pmod(F.xxhash64(F.lit(0), F.lit("block"), "doc_id"), F.lit(int(blocks)))
    assert hot.groupBy(at).agg(size).agg(F.max("n")).first()[0] * 10 < 3 * 500


def test_mixed_documents_cut_and_repeat(spark):
    rows = [(i, "ab" if i % 2 else "b", "w0 w1  w2\nw3 w4") for i in range(40)] + [(50, "a", None), (51, "c", "x y"), (52, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("shard", F.lit("mine"))
    plan = mixing.mix(docs, size=mixing.word_count())
    out = mixing.mixed_documents(plan).collect()
    per = collections.Counter()
    for r in out:
        assert len(r.text.split()) == r.words and r.text.split() == (dict((i, t) for i, _, t in rows)[r.doc_id] or "").split()[:r.words]
        per[r.doc_id] += r.words
    assert per == {r.doc_id: r.taken for r in plan.collect() if r.taken}
    assert mixing.mix(docs.limit(0), size=mixing.word_count()).count() == 0


# ---- language ID --------------------------------------------------------------

def test_language_id(spark):
    rng = random.Random(2)
    stems = {"aa": ["tion", "ing", "the"], "bb": ["öst", "ßen", "ich"], "cc": ["ción", "ñor", "los"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(rng.randint(1, 40))), k)
            for i, k in enumerate(rng.choice(sorted(stems)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 %% 3", "bb"), (903, "你好世界" * 20, None), (904, "thetion " * 100_000, "aa"),
             (904, "thetion " * 100_000, "aa"), (None, "ingthe", "aa"), (905, "ingthe", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("c0", F.lit(1))
    model = language_id.fit(language_id.train_rows(df), per_language=50)
    out = language_id.predict(df, model, keep=df.columns)
    assert out.columns == ["doc_id", "text", "lang", "c0", "lang_pred", "score", "rejected"]
    got = out.withColumn("held", language_id.held_out()).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held and r.doc_id < 900]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    special = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 900}
    for i in (900, 901, 902):
        assert (special[i].lang_pred, special[i].score, special[i].rejected) == ("und", 0.0, True)
    assert special[903].rejected and special[903].lang_pred in stems
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got if r.lang and r.text and r.doc_id is not None and r.doc_id < 900)
    nothing = language_id.fit(df.limit(0))
    assert {(r.lang_pred, r.rejected) for r in language_id.predict(df, nothing).collect()} == {("und", True)}
    assert language_id.predict(df.limit(0), model).count() == 0


def plain_ngrams(text):
    """Bins of the 1- to 3-grams, one character and one n-gram at a time."""
    mix, out = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), collections.Counter()
    chars = [0x20] + [0x20 if c < 0x61 or 0x7A < c < 0xAA else c for c in map(ord, text.lower())] + [0x20]
    for at in range(len(chars)):
        h = 0
        for n, c in enumerate(chars[at:at + 3]):
            h = (h ^ c) * mix[n] % (1 << 32)
            h ^= h >> 15
            out[(h * mix[0] % (1 << 32)) >> (32 - language_id.BITS)] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 20])
def test_ngrams_of_a_text_in_pieces(monkeypatch, chunk):
    monkeypatch.setattr(language_id, "_CHUNK", chunk)
    for text in ("", "a", "ab", "Abc", "ΑΣ ΣΑΣ. İx", "你好 world", "x1y" * 9, "the quick brown fox " * 3):
        bins, counts = language_id.ngram_counts(text)
        assert dict(zip(bins.tolist(), counts.tolist())) == dict(plain_ngrams(text))


def test_registered_language_id_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.train_rows(docs))
    got = {r.doc_id: r for r in entry.queries()["op4_language_id"](spark, SF).collect()}
    rows = docs.collect()
    seen, total = collections.Counter(), 0
    for r in rows:  # document frequencies over all rows to learn from
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text and any(c.isalpha() for c in r.text):
            seen.update(set(plain_ngrams(r.text)))
            total += 1
    right = tried = 0
    for r in rows:
        one = got[r.doc_id]
        assert one.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (one.lang_pred, one.score) == ("und", 0.0)
            continue
        weight = {b: (1 + math.log(n)) * (math.log((1 + total) / (1 + seen[b])) + 1) for b, n in plain_ngrams(r.text).items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        cosines = [sum(w * float(c[b]) for b, w in weight.items()) / norm for c in model.centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(one.score - cosines[best]) < 1e-4
        assert one.lang_pred == model.langs[best] or abs(max(c for c, lang in zip(cosines, model.langs) if lang == one.lang_pred) - cosines[best]) < 1e-4
        if one.held_out and r.lang:
            tried, right = tried + 1, right + (one.lang_pred == r.lang)
    assert tried > 20 and right >= 0.95 * tried


def test_unlearned_texts_are_rejected(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    prose = {
        "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita.",
        "pl": "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
        "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência."}
    bad = [*prose.values()]
    for n in (80, 600, 30_000):
        bad += [base64.b64encode(rng.randbytes(n)).decode(), "".join(rng.choice(string.ascii_lowercase) for _ in range(n)),
                " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(n // 6))]
    short = ["This.", "Anouble thwh.", "Eser thed nt of.", "Von.*** Keitkeitkeit.", "All rights reserved."]
    # a few odd texts among many do not set the floor
    odd = [(10**6 + i, t, "en") for i, t in enumerate(bad[3:5])]
    model = language_id.fit(language_id.train_rows(docs.union(spark.createDataFrame(odd, docs.schema))))
    given = spark.createDataFrame([(i, t) for i, t in enumerate(bad + short)], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in language_id.predict(given, model).collect()}
    assert [got[i] for i in range(len(bad + short))] == [True] * len(bad) + [False] * len(short)
    judged = language_id.predict(docs, model).withColumn("held", language_id.held_out()).where("held").collect()
    assert len(judged) > 100 and not any(r.rejected for r in judged)
    # one text says nothing of how far others may be
    one = language_id.fit(docs.where("lang = 'en'").limit(1))
    assert not any(r.rejected for r in language_id.predict(docs.where("lang = 'en'"), one).collect())


# ---- URL lists ----------------------------------------------------------------

def test_url_lists(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = spark.createDataFrame([
        ("bad", "host", "A.example.com", "add", day(10)), ("bad", "host", "a.example.com", "add", day(12)),
        ("bad", "host", "a.example.com", "remove", day(20)), ("bad", "host", "a.example.com", "add", day(30)),
        ("bad", "domain", "example.org", "add", day(0)), ("allow", "path", "b.example.org/ok", "add", day(5)),
        ("bad", "path", "b.example.org/ok/no", "add", day(5)), ("bad", "host", "gone.com", "remove", day(1)),
        ("bad", "host", "short.com", "add", day(3)), ("bad", "host", "short.com", "remove", day(3)),
        ("bad", "host", None, "add", day(1)), ("bad", "port", "80", "add", day(1))],
        "list string, kind string, value string, action string, at date")
    spans = validity_intervals(entries)
    got = sorted((r.value, str(r.valid_from), str(r.valid_to)) for r in spans.where("value = 'a.example.com'").collect())
    assert got == [("a.example.com", "2024-01-11", "2024-01-21"), ("a.example.com", "2024-01-31", "None")]
    assert spans.where("value = 'gone.com'").count() == 0
    cases = [("http://u:p@A.Example.com:8080/x?q#f", 9, "allowed", 0), ("http://a.example.com", 10, "blocked", 1), ("http://a.example.com/", 20, "allowed", 0),
             ("http://a.example.com./", 31, "blocked", 1), ("http://sub.a.example.com/", 31, "allowed", 0),
             ("https://b.example.org/", 6, "blocked", 1), ("https://b.example.org/ok/", 4, "blocked", 1), ("https://b.example.org/ok/x", 6, "allowed", 2),
             ("https://b.example.org/ok/no/y", 6, "blocked", 3), ("https://b.example.org/okay", 6, "blocked", 1), ("https://example.org", 1, "blocked", 1),
             ("https://notexample.org", 1, "allowed", 0), ("mailto:x", 1, "invalid", 0), (None, 1, "invalid", 0), ("http://a.example.com/", None, "allowed", 0),
             ("http://gone.com/", 9, "allowed", 0), ("http://x.com/" + "p/" * 3000, 1, "allowed", 0), ("", 1, "invalid", 0)]
    rows = [(i, u, None if d is None else day(d), "clash") for i, (u, d, *_) in enumerate(cases)]
    captures = spark.createDataFrame(rows + rows[:2], "page_id long, url string, fetched_at date, kind string")
    got = {r.page_id: (r.verdict, r.n_active) for r in asof_verdicts(captures, spans).collect()}
    assert got == {i: (v, n) for i, (_, _, v, n) in enumerate(cases)}
    assert asof_verdicts(captures.limit(0), spans).count() == 0 and asof_verdicts(captures, spans.limit(0)).where("n_active > 0").count() == 0


def test_url_addresses_long_urls_and_entry_spellings(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = spark.createDataFrame([("bad", k, v, "add", day(0)) for k, v in [
        ("host", "[2001:DB8::1]"), ("domain", "1"), ("domain", "db8::1]"), ("path", "A.Example.com/Dir/"), ("path", "b.com/"),
        ("path", "[2001:db8::2]/x"), ("path", "deep.com/" + "s/" * 4000 + "end"), ("domain", "x." * 200 + "com"), ("host", "dot.com."),
        ("path", ""), ("host", "h" * 300 + ".com"), ("domain", "com.")]],
        "list string, kind string, value string, action string, at date")
    spans = validity_intervals(entries).cache()
    assert {r.value for r in spans.where("kind = 'path'").collect()} == {
        "a.example.com/Dir", "b.com", "[2001:db8::2]/x", "deep.com/" + "s/" * 4000 + "end"}
    assert spans.where("kind = 'domain' AND length(value) > 253").count() == 0
    long = "http://deep.com/" + "s/" * 500_000  # 1 MB
    cases = [("http://[2001:db8::1]/", "[2001:db8::1]", "blocked", 1), ("http://[2001:db8::1]:8080/x", "[2001:db8::1]", "blocked", 1),
             ("http://[2001:ffff::9]/", "[2001:ffff::9]", "allowed", 0), ("http://u@[2001:DB8::2]/x/y", "[2001:db8::2]", "blocked", 1),
             ("http://[::ffff:1.2.3.1]/", "[::ffff:1.2.3.1]", "allowed", 0), ("http://1.2.3.1/", "1.2.3.1", "blocked", 1),
             ("http://a.example.net/Dir/", "a.example.net", "allowed", 0), ("http://a.example.com/Dir", "a.example.com", "blocked", 2),
             ("http://A.example.com/Dir/x?q", "a.example.com", "blocked", 2), ("http://a.example.com/dir", "a.example.com", "blocked", 1),
             ("http://a.example.com/Directory", "a.example.com", "blocked", 1), ("http://b.com/", "b.com", "blocked", 2), ("http://b.com", "b.com", "blocked", 2),
             (long, "deep.com", "blocked", 1), ("http://deep.com/" + "s/" * 4000 + "end/" + "t/" * 1000, "deep.com", "blocked", 2),
             ("http://dot.com./", "dot.com", "blocked", 2), ("http://" + "x." * 50_000 + "com/", "x." * 50_000 + "com", "blocked", 1),
             ("http://" + "h" * 300 + ".com/", "h" * 300 + ".com", "blocked", 2), ("http://[broken/", None, "invalid", 0)]
    captures = spark.createDataFrame([(i, u, day(1)) for i, (u, *_) in enumerate(cases)], "page_id long, url string, fetched_at date")
    began = time.time()
    got = {r.page_id: (r.host, r.verdict, r.n_active) for r in asof_verdicts(captures, spans).collect()}
    assert got == {i: (h, v, n) for i, (_, h, v, n) in enumerate(cases)}
    assert time.time() - began < 60


# ---- secrets ------------------------------------------------------------------

def test_secret_scan(spark):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice(["ther", "tion", "ing", "ble", "ous"]) for _ in range(rng.randint(4, 7)))
    rows, secret = [], {}
    for i in range(300):
        if i % 3 == 0:
            secret[i] = hexes(40)
            text = f'some words here token = "{secret[i]}" and more'
        else:
            text = f"the {word()} of {word()} and 1234567890123456{i}"
        rows.append((i, text, None if i % 7 == 0 else f"src{i % 4}"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "x" * 200_000, "s"), (903, "short", None), (None, f'token = "{hexes(40)}"', "s"), (903, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("label", F.lit("clash"))
    found = candidates(docs)
    assert {r.doc_id for r in found.collect() if r.doc_id in (900, 901, 902, 903)} == {902}
    label = F.when(F.col("candidate").rlike("^[0-9a-f]{40}$"), 1).when(F.col("candidate").rlike("^[a-z]+$|^[0-9]+$"), 0)
    labelled = found.where("doc_id % 2 = 0").withColumn("label", label)  # half of them, the rest is held out
    got = scan(docs, labelled).collect()
    assert len(got) == found.count()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2]
    assert len(held) > 100 and all(r.is_secret == (secret.get(r.doc_id) == r.candidate) for r in held)
    assert all(0 <= r.probability <= 1 for r in got)
    # candidates that are written already
    written = materialize(found, "test-candidates")
    again = scan(docs, labelled, found=written).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # labels of one class, no labels, no documents
    assert {r.is_secret for r in scan(docs, labelled.where("label = 1")).collect()} == {True}
    assert {r.is_secret for r in scan(docs, labelled.limit(0)).collect()} == {False}
    assert scan(docs.limit(0), labelled.limit(0)).count() == 0


def test_secret_query_scores_the_written_candidates(spark):
    got = entry.queries()["op6_secret_scan"](spark, SF)
    assert not any("documents.parquet" in f for f in got.inputFiles())
    runs = sum(len(re.findall(r"[A-Za-z0-9+/_\-]{16,}", r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert got.count() == runs > 0


@pytest.mark.parametrize("train_rows", [1, 5, 20, 20_000])
def test_secret_scan_of_many_copies(spark, train_rows):
    key = "0123456789abcdef" * 2
    rows = [(i, f'token = "{key}" x' if i % 2 else "a plainrunoflettersonly b", "s") for i in range(120)]
    rows += [(200 + i, f"other plainrunofletters{'abcdefgh'[i % 8] * (1 + i)} c", "s") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = candidates(docs)
    labelled = found.withColumn("label", F.when(F.col("candidate") == key, 1).otherwise(0))
    got = scan(docs, labelled, train_rows=train_rows).collect()
    assert len(got) == 150 and all(r.is_secret == (r.candidate == key) for r in got)


def test_dictionary_takes_words_of_any_length(spark):
    long = "ช" * 90
    docs = spark.createDataFrame([(i, f"{long} short a" if i % 2 else long) for i in range(6)], "doc_id long, text string")
    assert {r.word: r.n_docs for r in corpus_words(docs).collect()} == {long: 6, "short": 3}


def test_secret_candidates_of_one_word(spark):
    a, b, c = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENG", "f" * 15 + "0"
    path = "com/a/long/path/of/words"
    texts = [f'see {{"id":"{a}","secret":"{b}"}} end', f"k1={a};k2={b}", f"{a},{b},{c}", f"https://x.{path}?token={a}", f"{a}.{b}.{c}",
             f'x "{a}"', f'"{a}\'{b}', ";".join(f"k{i}={a}{i}" for i in range(20_000)), f"({a}) {b}"]
    found = candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path_col=None).collect()
    of = lambda i: sorted((r.word, r.run, r.candidate, r.before2, r.before, r.after, r.quoted) for r in found if r.doc_id == i)
    assert of(0) == [(1, 0, a, "see", '{"id":"', '","secret":"', True), (1, 1, b, a, '","secret":"', "end", True)]
    assert of(1) == [(0, 0, a, "", "k1=", ";k2=", False), (0, 1, b, a, ";k2=", "", False)]
    assert [r[2] for r in of(2)] == [r[2] for r in of(4)] == [a, b, c]
    assert of(3) == [(0, 0, path, "", "https://x.", "?token=", False), (0, 1, a, path, "?token=", "", False)]
    assert of(5) == [(1, 0, a, "", "x", "", True)]
    assert [(r[2], r[6]) for r in of(6)] == [(a, True), (b, False)]
    assert [r[2] for r in of(7)] == [f"{a}{i}" for i in range(20_000)]
    assert of(8) == [(0, 0, a, "", "", b, False), (1, 0, b, "", f"({a})", "", False)]


# ---- packing ------------------------------------------------------------------

def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdeé.'sI") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 3, 200, 900, 4000])))
             for _ in range(120)] + [None, "", " \n", "It's <|endoftext|> x²y ﬁ İI中文", "a" * 50_000, "b"] + ["same text of a copy"] * 300
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = pack_documents(docs).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert ids.tobytes() == token_bytes((t or "").encode(), default_tokenizer(), 1)
        mine = [r for r in got if r.doc_id == i and r.doc_tokens == len(ids)]
        assert mine and all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in mine if i)
        want[i, len(ids)] += len(ids)
    have = collections.Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
    assert have == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))
    assert len(by) <= 1.05 * sum(have.values()) / 2048 + 2
    assert pack_documents(docs.limit(0)).count() == 0


def test_registered_packing_on_a_given_table(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    docs = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
            for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.queries()["op7_pack"](spark, SF).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = docs[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(docs[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in docs.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
    total = sum(map(len, docs.values()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    # no more than one sequence above what a plain first-fit of the same pieces takes
    rooms: list[int] = []
    for length in sorted((n for p in pieces.values() for _, n in p), reverse=True):
        j = next((j for j, free in enumerate(rooms) if free >= length), None)
        if j is None:
            rooms.append(2048 - length)
        else:
            rooms[j] -= length
    assert -(-total // 2048) <= len(sequences) <= len(rooms) + 1


@pytest.mark.parametrize("seed", range(5))
def test_pack_histogram(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, rng.choice([3, 60, 2048])): rng.randint(1, 900) for _ in range(rng.choice([1, 9, 300]))}
    patterns, got = pack_histogram(counts), collections.Counter()
    for packs, pattern in patterns:
        assert packs > 0 and sum(length * times for length, times in pattern) <= 2048
        for length, times in pattern:
            got[length] += packs * times
    assert got == counts and len(patterns) <= 3 * len(counts)
    assert pack_histogram({1: 5000}) == [(2, [(1, 2048)]), (1, [(1, 904)])]


# ---- pipeline -----------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src1", None), (10**6 + 1, "%% 12", "en", "src1", 5), (10**6 + 2, "", None, None, 0)], docs.schema)
    docs = docs.union(extra)
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "mixing", "packing"]
    (_, language), (_, lines), (_, near), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    one = language(spark, docs, SF).cache()
    assert one.columns == columns and set(before) - {r.doc_id for r in one.collect()} >= {10**6, 10**6 + 1, 10**6 + 2}
    assert all(before[r.doc_id] == r for r in one.collect())
    two = lines(spark, one, SF).cache()
    assert two.columns == columns and two.count() == one.count()
    seen = collections.Counter(k for r in one.collect() for k in {x.strip().lower() for x in r.text.encode().split(b"\n")} if k)
    for r in two.collect():
        kept = [x for x in before[r.doc_id].text.encode().split(b"\n") if not x.strip() or seen[x.strip().lower()] < 10]
        assert r.text.encode() == b"\n".join(kept) and r.n_chars == len(r.text)
    three = near(spark, two, SF).cache()
    sets = {r.doc_id: (lambda w: set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set()))(
        r.text.encode().lower().split()) for r in two.collect()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i in sets if find(i) == i)
    four = mixed(spark, three, SF).cache()
    size, got = collections.Counter(), collections.Counter()
    for r in three.collect():
        size[r.source] += len(r.text.encode().split())
    for r in four.collect():
        got[r.source] += len(r.text.encode().split())
    want = plain_targets(size)
    assert four.columns == columns and all(abs(got[s] - want[s]) <= 0.5 for s in size)
    five = packed(spark, four, SF).collect()
    assert sum(r.length for r in five) == sum(len(token_bytes(r.text.encode(), default_tokenizer(), 1)) // 4 for r in four.collect())
    held = set(session._HELD)
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0
    left = {p.rpartition("/")[2].rpartition("-")[0] for p in session._HELD if p not in held}
    assert "pipeline-mixing" in left and not any(x.startswith(("near-", "line-", "mix-", "pipeline-l", "pipeline-n")) for x in left)


def test_pipeline_keeps_one_row_of_each_near_duplicate(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    a, b, c, d, e = (text(x) for x in "abcde")
    rows = [(1, a, "s1"), (5, a, "s1"), (5, c, "s1"), (7, b, "s2"), (7, b, "s1"), (7, b, "s1"), (None, d, "s1"), (None, a, "s1"),
            (9, d + " x", "s1"), (None, e, "s1"), (None, e.upper(), "s1"), (11, "", "s1"), (11, "", "s1"), (12, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    one = [r for r in got if r[0] is None]
    assert len(one) == 1 and one[0][1] in (e, e.upper())
    assert sorted((r for r in got if r[0] is not None), key=str) == sorted(
        [(1, a, "s1"), (5, c, "s1"), (7, b, "s1"), (9, d + " x", "s1"), (11, "", "s1"), (11, "", "s1"), (12, None, "s1")], key=str)


def test_pipeline_leaves_given_columns_alone(spark):
    clash = {"score": -5.0, "lang_pred": "x", "rejected": True, "n_lines": -7, "n_dropped": -8, "size": -9, "taken": -1, "words": -3, "shard": -2,
             "copy": -4, "source_size": 1, "target": 2, "placements": 3, "given": 4, "row": 5, "c0": 6, "keep_bitmap": "k", "a.b": "dotted"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit(v).alias(c) for c, v in clash.items()])
    (_, language), (_, lines), (_, near), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    for stage in (language, lines, near, mixed):
        docs = stage(spark, docs, SF)
        assert docs.columns[-len(clash):] == list(clash)
        docs = docs.cache()
        assert docs.count() > 0 and docs.select(*[F.col(f"`{c}`") for c in clash]).distinct().collect() == [tuple(clash.values())]
    assert packed(spark, docs, SF).count() > 0


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_every_query_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
