"""Conversation trie, covering SimHash and Merkle manifest against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cumulus.llm import queries
from cumulus.llm.common import ship, table
from cumulus.llm.conversation_trie import CHUNK, ENDS, numbered_turns, prefix_trie, rebuild
from cumulus.llm.merkle import fold, merkle_manifest, proof, row_digest
from cumulus.llm.simhash import LIMIT, covering_links, covering_masks, fingerprint, simhash_duplicates

#: Columns named like those the operators use inside or return.
CLASH = ["conv", "pos", "depth", "digest", "chars", "leaf", "root", "tree", "idx", "row", "mark", "t1", "component_id", "o0", "_tie"]


@pytest.fixture(scope="module", autouse=True)
def modules(spark):
    ship(spark)


def clash(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in df.columns])


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ---- conversation trie

def plain_trie(rows):
    """Nodes of (conv, turn, role, text) rows as tuples in the order of the operator's columns."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, bytes.fromhex(sha(f"{len(role.encode())}:{role}{text}")), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    members, ends, last, children = collections.defaultdict(list), collections.defaultdict(list), {}, collections.defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt = own.get(base, [])[:h] + own[c][h:]
        key = (0, "")
        members[key].append(c)
        last[key] = ""
        for role, text in rebuilt:
            up, key = key, (key[0] + 1, sha(f"{key[1]}|{len(role)}|{role}{text}"))
            members[key].append(c)
            last[key] = text
            children[up].add(key)
        ends[key].append(c)
    parent = {k: up for up, ks in children.items() for k in ks}
    saved = {k: (len(members[k]) - 1) * len(last[k]) for k in members}
    leaves = {k: int(not children[k]) for k in members}
    for k in sorted(members, key=lambda k: -k[0]):
        if k in parent:
            saved[parent[k]] += saved[k]
            leaves[parent[k]] += leaves[k]
    return collections.Counter(
        (min(members[k]), k[0], min(members[parent[k]]) if k in parent else None, len(members[k]), len(children[k]), leaves[k], saved[k],
         sha(",".join(map(str, sorted(ends[k]))))) for k in members)


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return prefix_trie(rebuild(numbered_turns(clash(df))))


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def conversations(seed=0):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(301, 330), 250, -150, -100, -101, -7, 10 ** 12, 10 ** 12 + 3]:
        first = rng.choice(["hello", "hi", "Ünï"])
        for turn in range(rng.randint(0, 8)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", first if turn < 2 else rng.choice("abc") * rng.randint(0, 3)))
    rows += [(20, 3, "user", "twice"), (20, 3, "user", "twice"), (21, None, None, None), (21, None, "system", "first"), (22, 5, "", ""),
             (None, 0, "user", "of no conversation"), (340, 0, "user", "long " * 200_000), (341, 0, "user", "one turn, taken from elsewhere")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_trie(spark, seed):
    rows = conversations(seed)
    assert counted(trie_of(spark, rows)) == plain_trie(rows)


def test_trie_common_conversation_and_long_one(spark):
    rows = [(c, t, "user", f"said {t}") for c in range(ENDS + 500) for t in range(2)]
    rows += [(50_000 + i, t, "user", f"said {t}" if t < 9 else f"{i} {t // 3}") for i in (0, 200) for t in range(2 * CHUNK + 10)]
    assert counted(trie_of(spark, rows)) == plain_trie(rows)


def test_trie_without_conversations(spark):
    assert trie_of(spark, []).count() == 0
    assert trie_of(spark, [(None, 1, "user", "x")]).count() == 0
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)  # takes its first turn from conversation 0, which is absent
    one = trie_of(spark, [(c, 1, "user", "abc")]).collect()
    assert [tuple(r) for r in one] == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


# ---- SimHash

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(marks, radius):
    """Least mark reachable of each of some distinct marks."""
    values = np.array(sorted(marks), dtype=np.uint64)
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius).tolist():
            a, b = find(i), find(i + 1 + j)
            label[max(a, b)] = min(a, b)
    return {int(v): int(values[find(i)]) for i, v in enumerate(values)}


def plain_simhash(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(set(marks), 3)
    least = {}
    for (i, _), m in zip(rows, marks, strict=True):
        if i is not None:
            least[group[m]] = min(least.get(group[m], i), i)
    return collections.Counter((i, f"{m:016x}", least.get(group[m])) for (i, _), m in zip(rows, marks, strict=True))


def simhash_rows(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(200, 400))) for _ in range(20)]
    for _ in range(60):
        words = rng.choice(texts[:6]).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["x", "Y", "zé"])
        texts.append("\t ".join(words))
    texts += [texts[0].upper(), texts[0], texts[0], "a b", "A\nB", "one", "", " \n", None, None, "ab cd " * 50, "é\x85x ü", "w " * 900_000]
    return [(3 * i, t) for i, t in enumerate(texts)] + [(6, "an id that comes twice"), (6, texts[1]), (None, texts[2]), (None, "a null id alone")]


@pytest.mark.parametrize("seed", [0, 1])
def test_simhash(spark, seed):
    rows = simhash_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(simhash_duplicates(clash(df))) == plain_simhash(rows)


def test_simhash_empty_and_whole_table(spark):
    assert simhash_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [tuple(r) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    assert counted(queries.QUERIES["op12_simhash"](spark, SF_SMALL)) == plain_simhash(rows)


def test_fingerprint_of_a_text_in_pieces():
    rng = random.Random(5)
    text = " ".join(rng.choice(["alpha", "Beta", "gämma", "d", "epsilon" * 9]) for _ in range(400_000))
    assert len(text.encode()) > 2 << 20
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_masks_cover_every_pair():
    masks = covering_masks(3)
    assert len(masks) == 15 and all(25 <= m.bit_count() <= 40 for m in masks)
    for bits in itertools.combinations(range(64), 3):
        apart = sum(1 << b for b in bits)
        assert any(not m & apart for m in masks)
    free = ((1 << 64) - 1) ^ masks[4]
    inner = covering_masks(3, free)
    assert all(m & ~free == 0 for m in inner)
    for bits in itertools.combinations([b for b in range(64) if free >> b & 1], 3):
        assert any(not m & sum(1 << b for b in bits) for m in inner)


@pytest.mark.parametrize("radius", [1, 3])
def test_links_in_crowded_buckets(spark, radius):
    rng = random.Random(radius)
    crowd = {sum(rng.getrandbits(1) << b for b in range(0, 60, 4)) for _ in range(3 * LIMIT)}  # 15 free bits: every table is crowded
    sparse = {rng.getrandbits(64) for _ in range(500)}
    chain = list(itertools.accumulate(rng.sample(range(64), 40), lambda x, b: x ^ (1 << b), initial=rng.getrandbits(64)))
    thinned = {m for i, m in enumerate(chain) if i % radius == 0}
    marks = crowd | sparse | thinned | {x ^ (1 << rng.randrange(64)) for x in list(sparse)[:100]}
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "mark long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in covering_links(df, radius).collect()]
    want = plain_groups(marks, radius)
    assert all(want[a] == want[b] for a, b in links)
    label = {m: m for m in marks}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    assert {m: find(m) for m in marks} == want


# ---- Merkle manifest

def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows, fanout=8):
    """rows of (doc_id, text, lang, source, n_chars): (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    leaf = lambda r, text: sha("".join(map(plain_field, (r[0], r[3], r[2], r[4], text))))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            run = level[at // fanout * fanout:][:fanout]
            yield run[:at % fanout], run[at % fanout + 1:]
            at //= fanout

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = {}
    for n in names:
        trees[n].sort(key=lambda x: x[:3])
        lower[n] = climb([x[2] for x in trees[n]])
    upper = climb([lower[n][-1][0] for n in names])
    out = collections.Counter()
    for g, n in enumerate(names):
        for at, (*_, own, r) in enumerate(trees[n]):
            path = [*way(lower[n], at), *way(upper, g)]
            low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            cur = leaf(r, low(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for before, after in path:
                cur = sha("".join(before) + cur + "".join(after))
            root = upper[-1][0]
            out[r[0], own, lower[n][-1][0], root, sha("".join("".join(a + b) for a, b in path)), cur, cur == root] += 1
    return out


def manifest_rows(n, langs, seed=0):
    rng = random.Random(seed)
    rows = [(i * 2, rng.choice(["Some Text ", "plain ", "Été "]) * rng.randint(0, 4), rng.choice(langs), rng.choice(["a", None]), i) for i in range(n)]
    rows += [(4, None, None, None, None), (None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (6, "twice", "en", "a", 2),
             (6, "twice", "en", "a", 2), (6, "Again", "en", "a", 2), (1001, "A" * 500_000, "", "", 0), (1003, "alone", "zz", "b", 3)]
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def manifest_of(df):
    """The registered query's expressions over any frame."""
    leaf = lambda text: row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    leaves = df.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.lit("given").alias("root"))
    return merkle_manifest(leaves)


@pytest.mark.parametrize("n, langs", [(700, ["en"] * 9 + [None, "de", "Ü"]), (0, ["en"]), (64, ["en"]), (90, [f"l{i}" for i in range(70)])])
def test_manifest(spark, tmp_out, n, langs):
    rows = manifest_rows(n, langs)
    clash(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_out}/documents.parquet")
    assert counted(queries.op13_merkle_manifest(spark, tmp_out)) == plain_manifest(rows)


def test_manifest_paths_other_fanout_and_one_tree(spark):
    rows = manifest_rows(100, ["en", "de"], seed=3)
    df = spark.createDataFrame(rows, DOCS)
    leaf = row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    got = merkle_manifest(df.select("doc_id", "lang", leaf.alias("leaf")), fanout=3)
    want = {(k[1], k[2], k[3], k[4]) for k in plain_manifest(rows, fanout=3)}
    assert {(r.leaf, r.subroot, r.root, r.p) for r in got.select("*", F.sha2(proof(F.col("path")), 256).alias("p")).collect()} == want
    single = merkle_manifest(df.select("doc_id", leaf.alias("leaf")), tree=None)
    tops = single.select("subroot", "root", fold(F.col("path"), F.col("leaf")).alias("folded")).distinct().collect()
    assert len(tops) == 1 and tops[0].subroot == tops[0].root == tops[0].folded


def test_manifest_small_tables(spark):
    assert manifest_of(spark.createDataFrame([], DOCS)).count() == 0
    one = manifest_of(spark.createDataFrame([(1, "x", None, None, 1)], DOCS)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []


# ---- the registered queries against their SQL

@pytest.mark.parametrize("key", ["op11_prefix_trie", "op13_merkle_manifest"])
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = queries.QUERIES[key](spark, SF_SMALL)
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[key]})").fetchall()
    assert counted(got) == collections.Counter(rows)
