"""Exact, line, substring and near deduplication against plain versions, with the odd rows every operator must bear."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus import session
from cumulus.llm.common import ship
from cumulus.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from cumulus.llm.line_dedup import apply_bitmaps, line_bitmaps
from cumulus.llm.near_dedup import MISS, REGISTERS, bands_for, components, joint_estimate, near_duplicates, shingle_set, sketches
from cumulus.llm.substring_dedup import repeated_passages
from cumulus.llm.words import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns named like those the operators use inside or return.
CLASH = ["row", "key0", "rank", "size", "taken", "n_lines", "keep_bitmap", "_doc_id", "block", "score", "c0", "_text", "digest"]


@pytest.fixture(scope="module", autouse=True)
def modules(spark):
    ship(spark)


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def corpus(seed=0):
    """(doc_id, text): copies, near copies, shared passages and lines, and the odd rows."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(30, 120))) for _ in range(25)]
    passage, line = " ".join(words(rng, 60)), "A  shared Line, said often."
    for i in range(12):
        w = words(rng, 80)
        texts.append(" ".join(w[:30] + passage.split()[: rng.randint(20, 60)] + w[30:]) + f"\n  {line} \nlast {i}")
    for _ in range(30):
        base = rng.choice(texts[:8]).split()
        for _ in range(rng.randint(1, 4)):
            base[rng.randrange(len(base))] = "".join(rng.choice("xyz") for _ in range(6))
        texts.append(" ".join(base))
    texts += [texts[3]] * 7 + ["ab cd " * 60, "ab cd " * 40, " ".join(words(rng, 20_000))]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "One"), (1005, "one two three"),
             (1006, "ÀB cd\x0bef\x85gh"), (1007, None)]
    rows += [(1010, "a row that comes twice"), (1010, "a row that comes twice"), (1011, "an id"), (1011, "with two texts")]
    return rows


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, None if i is None else "en", None) for i, t in rows], SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]) if clash else df


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    rows = corpus()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = max if keep == "largest" else min
    want = collections.Counter((i, best(groups[t or ""]), len(groups[t or ""]), sha(t or "")) for i, t in rows)
    got = exact_duplicates(frame(spark, rows, clash=True), keep=keep, salts=4).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    # one kept row per group, and it is the named one
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_normalised_null_ids_and_empty(spark):
    df = frame(spark, [(None, "A b"), (None, "a B"), (5, "a b"), (None, "other")])
    got = exact_duplicates(df, normalise=F.lower, keep="largest").collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 1, True), (0, 5, 3, False), (0, 5, 3, False), (5, 5, 3, True)]
    assert exact_duplicates(frame(spark, [])).count() == 0
    assert drop_exact_duplicates(frame(spark, [(1, "x"), (2, "x"), (3, None)], clash=True)).count() == 2


def plain_lines(rows, least):
    keys = lambda t: [x.strip().lower() for x in (t or "").encode().split(b"\n")]
    seen = collections.defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if k:
                seen[k].add((i, t))
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x, k in zip(lines, keys(t)) if not (k and len(seen[k]) >= least)]
        out[i, len(lines), len(lines) - len(kept), sha(b"\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, least):
    rows = corpus() + [(2000 + i, f"{'x' * 3}\n  SAME \t\n\n{i}") for i in range(9)] + [(2100, "same\nsame\n"), (None, "same")]
    df = frame(spark, rows, clash=True)
    got = apply_bitmaps(df, line_bitmaps(df, min_docs=least, salts=3))
    assert got.columns == [*[c for c in df.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text or "")) for r in got.collect()) == plain_lines(rows, least)
    assert got.where("doc_id = 1000").first().text is None


def test_lines_keep_first_short_keys_and_empty(spark):
    df = frame(spark, [(1, "aa\nb\naa"), (2, "b\naa"), (3, "AA\nc")])
    first = apply_bitmaps(df, line_bitmaps(df, min_docs=2, keep="first"))
    assert {r.doc_id: r.text for r in first.collect()} == {1: "aa\nb", 2: "", 3: "c"}
    long_only = apply_bitmaps(df, line_bitmaps(df, min_docs=2, min_chars=2))
    assert {r.doc_id: r.text for r in long_only.collect()} == {1: "b", 2: "b", 3: "c"}
    none = frame(spark, [])
    assert apply_bitmaps(none, line_bitmaps(none)).count() == 0


def plain_passages(rows, window):
    """Rows in order of (id, text) as documents; equal rows are one document."""
    seen, out = {}, {}
    for i, key, t in sorted({(-1 if i is None else i, k, t or "") for i, k, t in rows}):
        w = t.encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                keep[s:s + window] = [False] * window
            else:
                seen[k] = i
        out[i, key] = (len(w), keep.count(False), sha(b" ".join(x for x, k in zip(w, keep) if k)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    rows = corpus(seed) + [(None, corpus(seed)[30][1]), (None, None)]
    df = frame(spark, rows, clash=True)
    got = repeated_passages(df).collect()
    assert len(got) == len(rows)
    want = plain_passages([(r.doc_id, r.doc_key, t) for r, t in zip(
        df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("doc_key")).collect(),
        [t for _, t in rows])], 20)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id, r.doc_key], r.doc_id
        assert sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed
    assert sum(r.n_removed for r in got) > 500
    assert repeated_passages(frame(spark, [])).count() == 0


def test_word_hashes_do_not_depend_on_place():
    a, b = b"one  two\tthree", b"x one\ntwo three \x0b"
    assert list(word_hashes(a)) == list(word_hashes(b)[1:]) and len(word_hashes(b" ")) == 0
    long = b"word " * 300_000  # several chunks
    assert len(set(word_hashes(long).tolist())) == 1 and len(word_hashes(long)) == 300_000


def plain_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        least.setdefault(find(a), []).append(rows[a][0])
    out = collections.Counter()
    for a, (i, _) in enumerate(rows):
        ids = [x for x in least[find(a)] if x is not None]
        c = min(ids) if ids else None
        out[i, len(sets[a]), c, i == c] += 1
    return out


def test_bands_follow_the_threshold():
    assert bands_for(80) == (25, 4)
    for percent in (100, 95, 80, 70, 60, 50, 30, 12):
        bands, rows = bands_for(percent)
        assert bands * rows <= REGISTERS and (1 - (percent / 100) ** rows) ** bands <= MISS
    with pytest.raises(ValueError):
        bands_for(11)


def test_pairs_just_above_a_low_threshold(spark):
    rows = []
    for i in range(300):  # two of three shingles are shared: a similarity of 0.5 and a little
        a = [f"{i}x{j}" for j in range(64)]
        b = a[:44] + [f"{i}y{j}" for j in range(20)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    sets = [set(t.split()) for _, t in rows[:2]]
    assert 50 <= 100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 55
    got = near_duplicates(frame(spark, rows), k=1, percent=50).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


@pytest.mark.parametrize("k, percent", [(4, 80), (5, 70), (3, 50)])
def test_near_duplicates(spark, k, percent):
    rows = corpus(3) + [(None, "only row of its words"), (None, None)]
    got = near_duplicates(frame(spark, rows, clash=True), k=k, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain_components(rows, k, percent)


def test_near_links_that_miss_the_hub(spark):
    """A large group around one text: most pairs are below the threshold, links run over others."""
    rng = random.Random(9)
    base = words(rng, 60)
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        w = list(base)
        for j in range(rng.randint(1, 4)):
            w[(7 * i + 3 * j) % 60 if i % 2 else 10 + j] = f"edit{i // 6}x{j}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    got = near_duplicates(frame(spark, rows), k=4, percent=80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain_components(rows, 4, 80)


def test_near_leaves_only_the_tables_that_its_result_reads(spark):
    before = set(session._HELD)
    got = near_duplicates(frame(spark, corpus()), k=4)
    left = [p.rpartition("/")[2].rpartition("-")[0] for p in session._HELD if p not in before]
    assert sorted(left) == ["near-components", "near-sketches"] and got.count() == len(corpus())


def test_near_empty(spark):
    assert near_duplicates(frame(spark, []), k=4).count() == 0
    got = near_duplicates(frame(spark, [(1, None), (2, ""), (3, "  ")]), k=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 150)] + [(7, 9), (9, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 151)}, 7: 7, 9: 7}


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 6000, dtype=np.uint64)
    errors = []
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 1000
        both = int(round(2 * n * j / (1 + j)))
        for t in range(20):
            p = rng.permutation(pool)
            a, b = np.unique(p[:n]), np.unique(p[n - both:2 * n - both])
            s = sketches([a, b, np.union1d(a, b)])
            assert (np.maximum(s[0], s[1]) == s[2]).all()  # mergeable
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(joint_estimate(s[:1], s[1:2], np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2
    assert len(shingle_set(b"A b", 4)) == 1 and (shingle_set(b"A b", 4) == shingle_set(b"a  B", 4)).all()
