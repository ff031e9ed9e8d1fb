"""Mixing sources to target weights (DataFrame and SQL operations only).

Multivariate-hypergeometric splitting tree: every source's documents are dealt
into permuted blocks, its target becomes an exact quota of block draws, and the
vector of quotas is split in halves, level by level, until each output shard has
its own. A split draws the left half's share of every source from the
multivariate hypergeometric distribution, so each shard is a uniform sample
without replacement of all draws and the shards' quotas add up exactly. Each
shard then takes its quota of the source's permuted draws (disjoint by rank) and
orders its documents by a hash.

A block has about ``BLOCK_WORDS`` words and a shard some 64 blocks, so blocks, shards and what is written at a time stay
the same size and their number grows with the corpus. A source that holds a third of all words has a third of the
blocks. Ranks within a source are taken bin by bin of a hash, never in one
window over a source. A share is one draw from the hypergeometric distribution, whatever the quota; the sources of a node
are held in groups, so their number may be large (one row per source is sorted in one task, as their code point order asks).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.common import WORD_PATTERN, uniform
from cumulus.session import materialize

WEIGHTS = (1, 2, 3)
#: Words of a block, on average, and blocks of a shard.
BLOCK_WORDS = 1 << 17
BLOCKS_PER_SHARD = 64
#: Sources of a node that are split together.
GROUP = 256
#: Draws up to which a share is found by drawing one by one.
_FEW = 24


def word_count(text: str = "text"):
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source its index, ``target`` and quota.

    ``sources`` has ``source`` and ``source_size``. Sources weigh ``weights`` in turn
    by code point, null last, and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the excess is shared anew by weight. The
    fixed point has one level for all sources that are not stopped: the highest of the
    levels reached by stopping the sources in the order of ``most * size / weight``.
    The windows here run over one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_stop = every.orderBy(F.col("_cap") / F.col("_w"), "src")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    named = sources.withColumn("src", F.row_number().over(by_name)).select(
        "*", F.element_at(F.array(*[F.lit(w) for w in weights]),
                          F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1).alias("_w"),
        (F.col("source_size") * most).alias("_cap"))
    levels = named.select(
        "*", F.sum("source_size").over(every).alias("_total"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_stopped"),
        (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_left"))
    level = F.max((F.col("_total") - F.col("_stopped")) / F.col("_left")).over(every)
    return levels.withColumn("_level", level).select(
        "source", "src", "source_size", "_total",
        F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"),
    ).select("*", F.least(F.round("target").cast("long"), F.col("source_size") * most).alias("_quota"))


def _log_factorial(n: str) -> str:
    """SQL for ln(n!): exact logarithms below 16, Stirling's series from there on (to 1e-12)."""
    table = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(16))
    x = f"cast({n} + 1 AS double)"
    return (f"if({n} < 16, element_at(array({table}), cast({n} AS int) + 1), ({x} - 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D"
            f" + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}))")


def _let(values: dict[str, str], body: str) -> str:
    """SQL for ``body`` with names for values, each evaluated once."""
    for name, value in reversed(values.items()):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return body


def _share(rest: str, room: str, n: str, seed: str) -> str:
    """SQL for a draw from the hypergeometric distribution: how many of ``n`` of ``rest`` draws lie in the ``room`` places of the left
    half. ``seed`` is a list of SQL values for the hash.

    Few draws go one by one: each goes left with probability (places left there) / (draws left). More are found by
    inversion: probabilities are taken off a uniform number outwards from the mode, 12 standard deviations to each side.
    """
    u = f"(shiftrightunsigned(xxhash64({seed}, j), 11) * {2.0 ** -53!r}D)"
    walk = (f"aggregate(sequence(1L, n_), named_struct('rest', m_, 'room', k_), (a, j) -> named_struct('rest', a.rest - 1L,"
            f" 'room', a.room - if({u} * a.rest < a.room, 1L, 0L)), a -> k_ - a.room)")
    one = f"(shiftrightunsigned(xxhash64({seed}, 0L), 11) * {2.0 ** -53!r}D)"
    choose = lambda n, k: f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"
    up = "(a.up * (cast(k_ - t_ - i + 1 AS double) * (n_ - t_ - i + 1)) / (cast(t_ + i AS double) * (m_ - k_ - n_ + t_ + i)))"
    down = "(a.down * (cast(t_ - i + 1 AS double) * (m_ - k_ - n_ + t_ - i + 1)) / (cast(k_ - t_ + i AS double) * (n_ - t_ + i)))"
    step = _let({"x_": f"if(t_ + i <= hi_, {up}, 0D)", "y_": f"if(t_ - i >= lo_, {down}, 0D)"},
                "named_struct('u', a.u - x_ - y_, 'up', x_, 'down', y_, 'got',"
                " coalesce(a.got, if(a.u < x_, t_ + i, if(a.u < x_ + y_, t_ - i, cast(NULL AS bigint)))))")
    out = _let({"p_": f"exp({choose('k_', 't_')} + {choose('(m_ - k_)', '(n_ - t_)')} - {choose('m_', 'n_')})", "u_": one},
               "if(u_ < p_ OR w_ < 1, t_, aggregate(sequence(1L, w_), named_struct('u', u_ - p_, 'up', p_, 'down', p_, 'got',"
               f" cast(NULL AS bigint)), (a, i) -> {step}, a -> coalesce(a.got, t_)))")
    inverted = _let({
        "lo_": "greatest(0L, k_ + n_ - m_)", "hi_": "least(n_, k_)",
        "t_": "least(hi_, greatest(lo_, cast(floor((n_ + 1D) * (k_ + 1D) / (m_ + 2D)) AS bigint)))",
        "w_": "least(greatest(hi_ - t_, t_ - lo_), cast(ceil(12 * sqrt(n_ * (k_ / cast(m_ AS double)) * (1 - k_ / cast(m_ AS double))"
              " * ((m_ - n_) / greatest(1D, m_ - 1D)))) AS bigint) + 12L)"}, out)
    return _let({"m_": f"cast({rest} AS bigint)", "k_": f"cast({room} AS bigint)", "n_": f"cast({n} AS bigint)"},
                f"CASE WHEN n_ <= 0 OR k_ <= 0 THEN 0L WHEN k_ >= m_ THEN n_ WHEN n_ <= {_FEW} THEN {walk} ELSE {inverted} END")


def _split(seed: int) -> str:
    """SQL for one split of a node: the left half's share of each of its groups of sources, and within a
    group of each source, given what is left of draws and places. Together they are multivariate hypergeometric."""
    inner = _let({"took": _share("b.rest", "b.room", "q.n", f"{seed}, 'split', node, q.src")},
                 "named_struct('rest', b.rest - q.n, 'room', b.room - took, 'taken', array_append(b.taken, took))")
    none = "cast(array() AS array<bigint>)"
    group = _let(
        {"size": "aggregate(g, 0L, (c, q) -> c + q.n)",
         "left": _share("s.rest", "s.room", "size", f"{seed}, 'group', node, element_at(g, 1).src")},
        f"named_struct('rest', s.rest - size, 'room', s.room - left, 'taken', array_append(s.taken,"
        f" aggregate(g, named_struct('rest', size, 'room', left, 'taken', {none}), (b, q) -> {inner}, b -> b.taken)))")
    return (f"aggregate(quotas, named_struct('rest', total, 'room', total div 2, 'taken', cast(array() AS array<array<bigint>>)),"
            f" (s, g) -> {group}, s -> s.taken)")


def split_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """ACTION for many levels (writes every fourth): (src, n draws) for the whole mix to (shard, src, n) for each of
    ``2 ** levels`` shards. A node is one row: its sources with draws left, in groups of ``GROUP``."""
    entry = F.struct(F.col("src").cast("long").alias("src"), F.col("n").cast("long").alias("n"))
    groups = quotas.where("n > 0").groupBy(F.expr(f"src div {GROUP}").alias("g")).agg(F.array_sort(F.collect_list(entry)).alias("q"))
    nodes = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct("g", "q"))).alias("_g")).where(F.size("_g") > 0).select(
        F.lit(1).cast("long").alias("node"), F.transform("_g", lambda x: x["q"]).alias("quotas"))
    half = ("filter(zip_with(quotas, taken, (g, t) -> filter(zip_with(g, t, (q, k) -> named_struct('src', q.src, 'n', {})), q -> q.n > 0)),"
            " g -> size(g) > 0)")
    for level in range(levels):
        drawn = nodes.withColumn("total", F.expr("aggregate(flatten(quotas), 0L, (c, q) -> c + q.n)")).select(
            "node", "quotas", F.expr(_split(int(seed))).alias("taken"))
        nodes = drawn.select(F.expr(
            "explode(array("
            f"named_struct('node', node * 2, 'quotas', {half.format('k')}),"
            f"named_struct('node', node * 2 + 1, 'quotas', {half.format('q.n - k')})))").alias("_c")
        ).select("_c.node", "_c.quotas").where(F.size("quotas") > 0)
        if level % 4 == 3:
            # Cuts the plan, and deals the nodes out to more tasks.
            nodes = materialize(nodes.repartition("node"), "mix-nodes")
    return nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.explode(F.flatten("quotas")).alias("q")).select(
        "shard", "q.src", "q.n")


def _before(rows: DataFrame, amount: Column, by: Column, ties: Sequence[str], name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of the same ``src`` with a smaller hash ``by`` (then ``ties``): over the hash's bins
    first, then inside the row's bin, so no window holds a whole source."""
    binned = rows.withColumns({"_by": by, "_amount": amount}).withColumn("_bin", F.shiftrightunsigned("_by", 52))
    sums = binned.groupBy("src", "_bin").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy("src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.select("src", "_bin", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_bins"))
    inside = Window.partitionBy("src", "_bin").orderBy("_by", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return binned.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).join(bins, ["src", "_bin"]).withColumn(
        name, F.col("_bins") + F.col("_inside")).drop("_by", "_amount", "_bin", "_bins", "_inside")


def mix(docs: DataFrame, keys: Sequence[Column | str] = ("doc_id",), size: Column | str = "size", source: Column | str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = 3, levels: int | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD,
        block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """ACTION (writes one row per source, sums their sizes): plan the mix of ``docs``.

    ``keys`` name a document (its id, and what tells repeated ids apart); ``size`` is
    its length in words. Returns every row of ``docs``, those not taken too, with ``size``,
    ``source_size``, ``target`` (both of its source), ``taken`` (words, repeats
    counted) and ``placements``: an array of (shard, copy, words), one per time
    the document is drawn. Whole passes over a source take all its documents; the
    rest of its quota takes blocks in permuted order, and the last document drawn is
    cut so that the words taken are exactly the rounded target. So ``words`` is
    the document's size but for one document per source.

    Columns of ``docs`` with these names are replaced. A null size counts as 0; documents without words are
    never placed; null is a source of its own, the last. No rows in give no rows out. Rows that agree in all
    ``keys`` and in size are interchangeable. The result depends only on the rows and ``seed``. There are ``2 ** levels``
    shards, by default as many as give each ``blocks_per_shard`` blocks of ``block_words`` words, and 16 at least.
    """
    added = ["size", "source_size", "target", "taken", "placements"]
    length = F.coalesce((F.col(size) if isinstance(size, str) else size).cast("long"), F.lit(0).cast("long"))
    # The given columns travel in one struct, so none can clash with those of the plan.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), length.alias("length"),
                       (F.col(source) if isinstance(source, str) else source).alias("source"),
                       *[(F.col(k) if isinstance(k, str) else k).alias(f"key{i}") for i, k in enumerate(keys)])
    totals = rows.groupBy("source").agg(F.sum("length").alias("source_size"))
    planned = materialize(source_targets(totals, weights, most), "mix-targets")
    total = planned.agg(F.sum("source_size")).first()[0] or 0
    if levels is None:
        levels = max(4, (max(0, total - 1) // (block_words * blocks_per_shard)).bit_length())
    words = max(1, -(-total // (blocks_per_shard << levels)))
    sources = materialize(planned.select(
        F.col("source").alias("name"), "src", "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / words)).cast("long").alias("blocks"),
        F.when(F.col("source_size") > 0, F.expr("_quota div source_size")).otherwise(0).cast("long").alias("passes"),
        F.col("_quota").alias("quota")), "mix-sources")

    ids = [F.col(f"key{i}") for i in range(len(keys))]
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["name"])).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *ids), F.col("blocks")))

    # Per block its permuted place within the source, and the words drawn from it.
    sizes = placed.groupBy("src", "block", "passes", "quota", "source_size").agg(F.sum("length").alias("words"))
    permuted = _before(sizes, F.col("words"), F.xxhash64(F.lit(seed), F.lit("order"), "src", "block"), ["block"], "earlier")
    rest = F.col("quota") - F.col("passes") * F.col("source_size")
    part = F.least(F.col("words"), F.greatest(F.lit(0), rest - F.col("earlier")))
    draws = materialize(permuted.withColumn("part", part).select("src", "block", F.explode(F.expr(
        "concat(transform(if(passes > 0, sequence(1L, passes), array()), c -> named_struct('copy', c, 'words', words)),"
        " if(part > 0, array(named_struct('copy', passes + 1L, 'words', part)), array()))")).alias("d")
    ).select("src", "block", "d.copy", "d.words"), "mix-draws")

    # Shards take their quotas of the permuted draws: slot r of a source gets its r-th draw.
    ranked = _before(draws, F.lit(1).cast("long"), F.xxhash64(F.lit(seed), F.lit("draw"), "src", "block", "copy"), ["block", "copy"], "rank")
    leaves = split_quotas(draws.groupBy("src").agg(F.count(F.lit(1)).alias("n")), levels, seed)
    # One row per source and shard in the window, whatever the number of draws.
    taken = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = leaves.withColumn("first", F.coalesce(F.sum("n").over(taken), F.lit(0))).select(
        "src", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    drawn = ranked.join(slots, ["src", "rank"]).groupBy("src", "block").agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard", "words"))).alias("draws"))

    inside = Window.partitionBy("src", "block").orderBy(
        F.xxhash64(F.lit(seed), F.lit("doc"), *ids), *ids, "length").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("before", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(
        drawn, ["src", "block"], "left")
    placements = F.expr(
        "filter(transform(coalesce(draws, array()), d -> named_struct('shard', cast(d.shard AS int), 'copy', cast(d.copy AS int),"
        " 'words', greatest(0L, least(length, d.words - before)))), p -> p.words > 0)")
    return at.select("row", "length", "source_size", "target", placements.alias("placements")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], F.col("length").alias("size"), "source_size", "target",
        F.expr("aggregate(placements, 0L, (t, p) -> t + p.words)").alias("taken"), "placements")


def mixed_documents(plan: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", seed: int = 0) -> DataFrame:
    """The mix itself from :func:`mix`: one row per placement with ``shard``, ``copy`` and ``words``
    in place of ``placements`` (and of given columns with these names).

    A document cut to fewer words than it has keeps its first words, joined by
    single spaces; the others keep their text. Rows are dealt by shard and within a shard
    shuffled by a hash. A shard is one output file's worth of rows.
    """
    added = ["placements", "shard", "copy", "words"]
    rows = plan.select(F.struct(*[F.col(f"`{c}`") for c in plan.columns if c not in added]).alias("row"), F.explode("placements").alias("p"))
    words = F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(f"({WORD_PATTERN})"), F.lit(1))
    first = F.array_join(F.slice(words, F.lit(1), F.col("p.words").cast("int")), " ")
    ids = [F.col(f"row.`{k}`") for k in keys]
    dealt = rows.repartition(F.col("p.shard"), F.pmod(F.xxhash64(*ids), F.lit(16))).sortWithinPartitions(
        "p.shard", uniform(seed, "place", F.col("p.shard"), *ids, F.col("p.copy")))
    return dealt.select(
        *[(F.when(F.col("p.words") < F.col("row.size"), first).otherwise(F.col(f"row.`{c}`")) if c == text
           else F.col(f"row.`{c}`")).alias(c) for c in plan.columns if c not in added], "p.shard", "p.copy", "p.words")
