"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cumulus.llm import language_id
from cumulus.llm.common import SPACES, shipped, table, text_key
from cumulus.llm.conversation_trie import numbered_turns, prefix_trie, rebuild
from cumulus.llm.exact_dedup import exact_duplicates
from cumulus.llm.line_dedup import apply_bitmaps, line_bitmaps
from cumulus.llm.merkle import fold, merkle_manifest, proof, row_digest
from cumulus.llm.mixing import mix, word_count
from cumulus.llm.near_dedup import near_duplicates
from cumulus.llm.packing import pack_documents
from cumulus.llm.secret_scan import candidates, scan
from cumulus.llm.simhash import simhash_duplicates
from cumulus.llm.substring_dedup import repeated_passages
from cumulus.llm.topk_search import integer_vectors, top_k
from cumulus.llm.url_filter import asof_verdicts, url_host, url_path, validity_intervals
from cumulus.session import materialize


def op1_topk_search(spark, sf_dir):
    """The ten highest inner products of every hundredth vector against all others."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_substring_dedup(spark, sf_dir):
    """Words of every document covered by a 20-word window that also starts earlier."""
    return repeated_passages(table(spark, sf_dir, "documents"), window=20).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op3_mix_sources(spark, sf_dir):
    """All documents mixed to source weights 1, 2, 3 in turn, at most three times each."""
    sized = materialize(table(spark, sf_dir, "documents").select(
        "doc_id", "source", text_key().alias("key"), word_count().alias("size")), "mix-sizes")
    return mix(sized, ["doc_id", "key"]).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark, sf_dir):
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.train_rows(docs))
    return language_id.predict(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _hash_number(text):
    """A repeatable number from a text that SQL can compute too."""
    return F.conv(F.left(F.md5(text), F.lit(7)), 16, 10).cast("int")


def _list_entries(pages):
    """Dated list entries derived from the pages' own hosts, domains and first path segments."""
    urls = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).where("host IS NOT NULL")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)

    def entries(values, kind, list_name, share, since, until):
        n = values.distinct().withColumn("n", _hash_number(F.col("value"))).where(share)
        entry = lambda action, at: n.select(
            F.lit(list_name).alias("list"), F.lit(kind).alias("kind"), "value", F.lit(action).alias("action"), day(at).alias("at"))
        return entry("add", F.expr(since)).union(entry("remove", F.expr(until)))

    segment = F.regexp_extract("path", "^/([^/]+)", 1)
    return (entries(urls.select(F.col("host").alias("value")), "host", "malware", "n % 3 = 0", "n % 200", "n % 200 + 30 + n % 90")
            .union(entries(urls.select(F.substring_index("host", ".", -3).alias("value")), "domain", "adult", "n % 5 = 1",
                           "n % 250", "n % 250 + 60"))
            .union(entries(urls.where(segment != "").select(F.concat("host", F.lit("/"), segment).alias("value")), "path", "allow",
                           "n % 4 = 0", "n % 150", "n % 150 + 100")))


def op5_url_filter(spark, sf_dir):
    """Every page judged by the list entries active on the day it was fetched."""
    pages = table(spark, sf_dir, "pages")
    entries = materialize(_list_entries(pages), "url-entries")
    captures = pages.select("page_id", "url", F.date_add(
        F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")).alias("fetched_at"))
    return asof_verdicts(captures, validity_intervals(entries))


def op6_secret_scan(spark, sf_dir):
    """Every candidate key of every document, scored by a forest trained on findings labelled by their form:
    hexadecimal keys of 32 or more digits assigned in quotes are secrets, runs of letters or of digits are not."""
    docs = table(spark, sf_dir, "documents")
    found = materialize(candidates(docs), "secret-candidates")
    key = F.col("candidate").rlike("^([0-9a-f]{32,}|[0-9A-F]{32,})$") & F.col("quoted") & F.col("before").rlike("[=:]")
    plain = F.col("candidate").rlike(r"^([A-Za-z/+_\-]+|[0-9/+_\-]+)$")
    return scan(docs, found.withColumn("label", F.when(key, 1).when(plain, 0)), found=found)


def op7_pack(spark, sf_dir):
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    """Lines found in ten documents or more go from all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, line_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_near_dedup(spark, sf_dir):
    """Components of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_exact_dedup(spark, sf_dir):
    """Groups of identical texts; the row with the largest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op11_prefix_trie(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt with the first turns they share."""
    return prefix_trie(rebuild(numbered_turns(table(spark, sf_dir, "conversations"))))


def op12_simhash(spark, sf_dir):
    """Components of documents whose 64-bit fingerprints differ in three bits or fewer."""
    return simhash_duplicates(table(spark, sf_dir, "documents"), k=3, radius=3)


def op13_merkle_manifest(spark, sf_dir):
    """The inclusion proof of every document, folded again from a tampered text where 3 divides the id's checksum."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(
        tampered, leaf(F.translate("text", upper, upper.lower()))).alias("changed"))
    manifest = merkle_manifest(leaves, leaf="leaf", tree="lang", order=["doc_id"])
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: shipped(f) for f in (
    op1_topk_search, op2_substring_dedup, op3_mix_sources, op4_language_id, op5_url_filter, op6_secret_scan, op7_pack,
    op8_line_dedup, op9_near_dedup, op10_exact_dedup, op11_prefix_trie, op12_simhash, op13_merkle_manifest)}

_SPACES_SQL = " || ".join(f"chr({ord(c)})" for c in SPACES)

def _entries_sql(values, kind, list_name, share, since, until):
    entry = "SELECT '{}' AS list, '{}' AS kind, value, '{}' AS action, DATE '2024-01-01' + CAST({} AS INTEGER) AS at FROM {} WHERE {}"
    return " UNION ALL ".join(entry.format(list_name, kind, action, at, values, share) for action, at in (("add", since), ("remove", until)))


#: Unsigned crc32 of a decimal number, bit by bit.
_CRC32_SQL = """xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, byte)),
    CAST(4294967295 AS BIGINT)), 4294967295)"""


_WORDS_SQL = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text):
    fields = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


ORACLE_SQL = {
    "op1_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, r.vec_id,
                 CAST(coalesce(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
          FROM v q JOIN v r ON r.vec_id <> q.vec_id AND len(r.v) = len(q.v) WHERE q.vec_id % 100 = 0),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10""",
    "op2_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20),
        k AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS key FROM s),
        l AS (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS nth FROM k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM l WHERE nth > 1),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        kept AS (
          SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op5_url_filter": rf"""
        WITH p AS (
          SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched_at,
                 nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1)),
                        '\.$', ''), '') AS host,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
          FROM (SELECT DISTINCT page_id, url FROM pages)),
        h AS (SELECT value, CAST('0x' || substr(md5(value), 1, 7) AS INTEGER) AS n
              FROM (SELECT DISTINCT host AS value FROM p WHERE host IS NOT NULL)),
        d AS (SELECT value, CAST('0x' || substr(md5(value), 1, 7) AS INTEGER) AS n
              FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS value FROM p WHERE host IS NOT NULL)),
        s AS (SELECT value, CAST('0x' || substr(md5(value), 1, 7) AS INTEGER) AS n
              FROM (SELECT DISTINCT host || '/' || regexp_extract(path, '^/([^/]+)', 1) AS value FROM p
                    WHERE host IS NOT NULL AND regexp_extract(path, '^/([^/]+)', 1) <> '')),
        e AS ({_entries_sql("h", "host", "malware", "n % 3 = 0", "n % 200", "n % 200 + 30 + n % 90")} UNION ALL
              {_entries_sql("d", "domain", "adult", "n % 5 = 1", "n % 250", "n % 250 + 60")} UNION ALL
              {_entries_sql("s", "path", "allow", "n % 4 = 0", "n % 150", "n % 150 + 100")}),
        i AS (SELECT a.list, a.kind, a.value, a.at AS valid_from, r.at AS valid_to
              FROM e a JOIN e r ON a.action = 'add' AND r.action = 'remove' AND a.list = r.list AND a.kind = r.kind AND a.value = r.value),
        m AS (
          SELECT p.page_id, p.url, i.kind || ':' || i.value AS entry, CASE WHEN i.list = 'allow' THEN 0 ELSE 1 END AS blocks,
                 CASE i.kind WHEN 'domain' THEN len(string_split(i.value, '.')) WHEN 'host' THEN 1000
                             ELSE 2000 + len(string_split(i.value, '/')) - 1 END AS depth
          FROM p JOIN i ON p.fetched_at >= i.valid_from AND p.fetched_at < i.valid_to AND (
            (i.kind = 'host' AND i.value = p.host)
            OR (i.kind = 'domain' AND (i.value = p.host OR (ends_with(p.host, '.' || i.value) AND NOT starts_with(p.host, '['))))
            OR (i.kind = 'path' AND starts_with(p.host || p.path || '/', i.value || '/'))))
        SELECT p.page_id, p.url, p.fetched_at, p.host, count(m.entry) AS n_active,
               CASE WHEN p.host IS NULL THEN 'invalid'
                    WHEN arg_min(m.blocks, (-m.depth, m.blocks, m.entry)) = 1 THEN 'blocked' ELSE 'allowed' END AS verdict,
               arg_min(m.entry, (-m.depth, m.blocks, m.entry)) AS matched
        FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.url = p.url
        GROUP BY p.page_id, p.url, p.fetched_at, p.host""",
    "op8_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {_SPACES_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id""",
    "op9_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL.format(_LOWER_SQL)} AS ws FROM documents),
        sh AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                 ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
          SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
        SELECT reach.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id,
               reach.doc_id = min(r) AS kept
        FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op11_prefix_trie": f"""
        WITH given AS (
          SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
                 length(coalesce(text, '')) AS chars
          FROM conversations WHERE conv_id IS NOT NULL),
        t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM given),
        n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
        v AS (SELECT n.c, c - c % 100 AS base, {_CRC32_SQL.format("c")} % 6 AS h FROM n),
        r AS (
          SELECT v.c, b.pos + 1 AS depth, b.d, b.chars FROM v JOIN t b ON b.c = v.base AND b.pos < v.h
          UNION ALL
          SELECT v.c, t.pos - v.h + least(v.h, coalesce(n.n, 0)) + 1, t.d, t.chars
          FROM v JOIN t ON t.c = v.c AND t.pos >= v.h LEFT JOIN n ON n.c = v.base),
        p AS (
          SELECT c, 0 AS depth, '' AS key, 0 AS chars FROM v
          UNION ALL SELECT c, depth, string_agg(d, '') OVER (PARTITION BY c ORDER BY depth), chars FROM r),
        nodes AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY key, depth),
        children AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        below AS (
          SELECT left(key, 64 * j) AS key, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (childless) AS leaves
          FROM (SELECT nodes.*, children.n IS NULL AS childless, unnest(range(0, depth + 1)) AS j
                FROM nodes LEFT JOIN children ON children.key = nodes.key) GROUP BY 1),
        ends AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
                 FROM (SELECT c, arg_max(key, depth) AS key FROM p GROUP BY c) GROUP BY key)
        SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, a.n_convs, coalesce(children.n, 0) AS n_children,
               below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, coalesce(ends.ends, sha256('')) AS ends_sha256
        FROM nodes a JOIN below ON below.key = a.key LEFT JOIN children ON children.key = a.key LEFT JOIN ends ON ends.key = a.key
        LEFT JOIN nodes parent ON a.depth > 0 AND parent.key = left(a.key, 64 * (a.depth - 1))""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
          SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC32_SQL.format("doc_id")} % 3 = 0
                 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
          FROM documents),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
        nodes AS (
          SELECT 0 AS level, lang, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM o
          UNION ALL
          SELECT level + 1, lang, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8
          FROM nodes WHERE n > 1 GROUP BY level, lang, idx // 8),
        subroots AS (SELECT lang, level, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM nodes WHERE n = 1),
        tops AS (
          SELECT 0 AS level, g AS idx, h, count(*) OVER () AS n FROM subroots
          UNION ALL
          SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8
          FROM tops WHERE n > 1 GROUP BY level, idx // 8),
        low AS (
          SELECT lang, pos, 0 AS level, pos AS idx, coalesce(changed, leaf) AS cur, '' AS sibs FROM o
          UNION ALL
          SELECT f.lang, f.pos, f.level + 1, f.idx // 8, sha256(string_agg(CASE WHEN v.idx = f.idx THEN f.cur ELSE v.h END, '' ORDER BY v.idx)),
                 f.sibs || coalesce(string_agg(v.h, '' ORDER BY v.idx) FILTER (v.idx <> f.idx), '')
          FROM low f JOIN nodes v ON v.level = f.level AND v.lang IS NOT DISTINCT FROM f.lang AND v.idx // 8 = f.idx // 8 AND v.n > 1
          GROUP BY f.lang, f.pos, f.level, f.idx, f.cur, f.sibs),
        high AS (
          SELECT low.lang, low.pos, 0 AS level, s.g AS idx, low.cur, low.sibs
          FROM low JOIN subroots s ON s.lang IS NOT DISTINCT FROM low.lang AND s.level = low.level
          UNION ALL
          SELECT f.lang, f.pos, f.level + 1, f.idx // 8, sha256(string_agg(CASE WHEN v.idx = f.idx THEN f.cur ELSE v.h END, '' ORDER BY v.idx)),
                 f.sibs || coalesce(string_agg(v.h, '' ORDER BY v.idx) FILTER (v.idx <> f.idx), '')
          FROM high f JOIN tops v ON v.level = f.level AND v.idx // 8 = f.idx // 8 AND v.n > 1
          GROUP BY f.lang, f.pos, f.level, f.idx, f.cur, f.sibs)
        SELECT o.doc_id, o.leaf, s.h AS subroot, root.h AS root, sha256(high.sibs) AS proof_sha256, high.cur AS folded_root,
               high.cur = root.h AS verified
        FROM o JOIN subroots s ON s.lang IS NOT DISTINCT FROM o.lang
        JOIN (SELECT h, level FROM tops WHERE n = 1) root ON true
        JOIN high ON high.lang IS NOT DISTINCT FROM o.lang AND high.pos = o.pos AND high.level = root.level""",
}
