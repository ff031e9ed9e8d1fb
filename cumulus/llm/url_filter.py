"""URL filters: a temporal join of captures with dated list entries.

A list's history is a log of dated entries (a host, a domain or a path prefix, added or
removed). Entries become validity intervals; a capture is judged by the entries
active when it was fetched, so a later list does not change an earlier verdict.

A capture asks for few exact keys: its host, the host's parent domains, and its path cut at the
lengths that the lists name for that host. So the as-of join is an equality join on the key with an interval
condition, and the work is linear in a URL's length, however many slashes it has. Only keys
that some list names meet a capture; adaptive execution splits
the joins on a host that a third of all captures share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an entry may name, from least to most specific.
KINDS = ("domain", "host", "path")
#: Fixed value: characters of a domain name at most; a longer entry names no domain.
DOMAIN_CHARS = 253
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


def _entry_value():
    """An entry's value as captures ask for it: host names in lower case and without a trailing dot; a path
    entry (host, path) without closing slashes, its path as it stands."""
    host = F.regexp_replace(F.lower(F.substring_index("value", "/", 1)), r"\.$", "")
    path = F.regexp_replace(F.regexp_extract("value", r"^[^/]*(/.*)$", 1), "/+$", "")
    named = F.regexp_replace(F.lower("value"), r"\.$", "")
    return F.nullif(F.when(F.col("kind") == "path", F.concat(host, path)).otherwise(named), F.lit(""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) from (list, kind, value, action, at).

    An ``add`` opens an interval and the next ``remove`` of the same list, kind and value closes it;
    it stays open (null) without one. Repeated adds and removes change nothing. On the same date a remove
    counts before an add. Entries with a null in any field are left out, and domains of more than
    ``DOMAIN_CHARS`` characters, which no host can lie in. Values are compared in lower case, but for the path
    after a host; closing slashes of a path and a closing dot of a host do not count. An IPv6 host is written in brackets.
    """
    clean = entries.select("list", "kind", _entry_value().alias("value"), "action", "at").dropna().where(
        F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove")
        & ((F.col("kind") != "domain") | (F.length("value") <= DOMAIN_CHARS))).distinct()
    of_entry = Window.partitionBy("list", "kind", "value").orderBy("at", F.col("action").desc())
    turns = clean.withColumn("_last", F.lag("action").over(of_entry)).where(
        ~F.col("action").eqNullSafe(F.col("_last")) & ~((F.col("action") == "remove") & F.col("_last").isNull()))
    return turns.withColumn("valid_to", F.lead("at").over(of_entry)).where("action = 'add'").select(
        "list", "kind", "value", F.col("at").alias("valid_from"), "valid_to").where(
        F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))


def url_host(url):
    """Lower-case host of an absolute URL without user, port and trailing dot; null if there is none. An
    IPv6 address stands whole, in its brackets."""
    host = F.lower(F.regexp_extract(url, _AUTHORITY + r"(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def url_path(url):
    """Path of an absolute URL without query and fragment, "/" if empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def host_keys(host):
    """Array of (kind, value, depth): the host and its parent domains, at most ``DOMAIN_CHARS`` long. An
    address in brackets has no parents."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - DOMAIN_CHARS // 2)
    domains = F.filter(F.transform(F.sequence(first, F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"),
        (F.size(labels) - i + 1).alias("depth"))), lambda k: F.length(k["value"]) <= DOMAIN_CHARS)
    whole = F.array(F.struct(F.lit("domain").alias("kind"), host.alias("value"), F.lit(1).alias("depth")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(1000).alias("depth")))
    return F.concat(F.when(host.startswith("["), whole).otherwise(domains), own)


def path_keys(host, path, lengths):
    """Array of (kind, value, depth) for the listed ``lengths``: the host and path cut there, where a slash or the end follows."""
    whole = F.concat(host, F.regexp_replace(path, "/$", ""))
    cut = lambda n: F.substring(whole, F.lit(1), n)
    ends = lambda n: (n == F.length(whole)) | (F.substring(whole, n + 1, F.lit(1)) == "/")
    return F.transform(F.filter(lengths, lambda n: (n <= F.length(whole)) & ends(n)), lambda n: F.struct(
        F.lit("path").alias("kind"), cut(n).alias("value"),
        (F.lit(2000) + F.length(cut(n)) - F.length(F.translate(cut(n), "/", ""))).alias("depth")))


def asof_verdicts(captures: DataFrame, intervals: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  time_col: str = "fetched_at", allow_list: str = "allow") -> DataFrame:
    """One row per capture: id, url, time, ``host``, ``n_active`` (entries active at fetch
    time), ``verdict`` and ``matched`` (kind:value of the deciding entry).

    The most specific active entry decides: the longest path, then the host, then the
    longest domain; ``allow_list`` wins a tie. ``blocked`` if another list decides, else ``allowed``.
    Without an active entry, or without a fetch time, a capture is ``allowed``; a URL that is null or without a
    host is ``invalid``. Captures are told apart by id, URL and time: rows that agree in all
    three share one row of the result. Other columns are ignored.
    """
    given = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at")).distinct()
    split = given.select("*", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("_path"))
    hosted = split.where(F.col("host").isNotNull())
    # Different lengths of a host's listed paths: at most as many as a path has characters.
    listed = intervals.where("kind = 'path'").groupBy(F.substring_index("value", "/", 1).alias("host")).agg(
        F.collect_set(F.length("value")).alias("_lengths"))
    keys = hosted.select("_id", "_url", "_at", F.explode(host_keys(F.col("host"))).alias("_k")).union(
        hosted.join(listed, "host").select("_id", "_url", "_at", F.explode(
            path_keys(F.col("host"), F.col("_path"), F.col("_lengths"))).alias("_k")))
    asked = keys.select("_id", "_url", "_at", F.col("_k.kind").alias("kind"), F.col("_k.value").alias("value"), "_k.depth")
    active = asked.join(intervals, ["kind", "value"]).where(
        (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    blocks = F.when(F.col("list") == allow_list, 0).otherwise(1)
    decided = active.groupBy("_id", "_url", "_at").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.min(F.struct((-F.col("depth")).alias("depth"), blocks.alias("blocks"), F.concat_ws(":", "kind", "value").alias("entry"))).alias("_top"))
    g, d = split.alias("g"), decided.alias("d")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("_id", "_url", "_at")]
    verdict = (F.when(F.col("g.host").isNull(), "invalid").when(F.col("d._top.blocks") == 1, "blocked").otherwise("allowed"))
    return g.join(d, same, "left").select(
        F.col("g._id").alias(id_col), F.col("g._url").alias(url_col), F.col("g._at").alias(time_col), F.col("g.host").alias("host"),
        F.coalesce("d.n_active", F.lit(0)).cast("long").alias("n_active"), verdict.alias("verdict"),
        F.col("d._top.entry").alias("matched"))
