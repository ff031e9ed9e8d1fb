"""Prefix trie of conversations: whole-sequence collapse.

Turns are numbered within their conversation and become terms: two 64-bit hashes of place, role and text.
The exclusive or of the first d terms names a prefix, so prefixes, whole sequences and parents
(a prefix without its last term) are computed without holding a conversation's turns together.

1. Identical rebuilt conversations collapse into one weighted sequence with a list of ends.
2. A sequence that is a proper prefix of another is dropped from the leaves by an anti-join.
3. Prefixes of the weighted sequences are aggregated into nodes: weights, leaves, smallest member.
4. Subtree sums: a node belongs to the sequence of its smallest member, where it has only nodes of the
   same sequence below it. So a sequence's own nodes are one chain to its end, a sum over a subtree is
   the rest of the node's own chain and all of the chains that pass it, and no node is counted twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.common import partitions
from cumulus.operators.shapes import dense_ordinal
from cumulus.session import materialize

#: Turns of a conversation that a running value takes in one piece; longer ones are carried over.
CHUNK = 4096
#: Ends listed in one piece of text before it is hashed.
ENDS = 8192
#: Conversations that share their first turns, and the most turns shared.
BLOCK, SHARED = 100, 6

_NODE = ["depth", "p1", "p2"]


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """ACTION: (conv, pos, digest, chars), pos from 0 in each conversation.

    Order: the turn number, null first; tied turns, repeated rows too, all stay, in the order of the SHA-256 of
    role and text. A null role or text is empty. Rows without a conversation id belong to none and are passed over.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = materialize(conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars")).where("conv IS NOT NULL"), "trie-turns")
    return materialize(dense_ordinal(rows, "pos", order_by=["turn", "digest"], within=["conv"]).select(
        "conv", "pos", "digest", "chars"), "trie-numbered")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its block's first: crc32 of its decimal id, mod 6."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED))


def rebuild(turns: DataFrame) -> DataFrame:
    """ACTION: (conv, depth, digest, chars) of the rebuilt conversations, depth from 1, and one row at
    depth 0 (digest null) for each.

    Conversation c starts with the first h turns of conversation c - c % 100 (all if it has
    fewer, none if it is absent), then come its own turns after its first h. The remainder has the sign of c.
    """
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "n", shared_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("base"))
    sizes = own.where(f"conv % {BLOCK} = 0").select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = materialize(own.join(sizes, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "trie-conversations")
    heads = turns.where((F.col("conv") % BLOCK == 0) & (F.col("pos") < SHARED - 1)).withColumnRenamed("conv", "base")
    borrowed = convs.join(heads, "base").where("pos < taken").select("conv", (F.col("pos") + 1).alias("depth"), "digest", "chars")
    rest = turns.where(F.col("pos") >= shared_turns(F.col("conv"))).join(convs, "conv").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "chars")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                         F.lit(0).cast("long").alias("chars"))
    return rest.union(borrowed).union(roots)


def _running(rows: DataFrame, key: str, order: str, values: dict[str, tuple[str, object]], backward: bool = False) -> DataFrame:
    """Adds running values along ``order`` within ``key``: ``values`` maps a name to (column, aggregate
    of a column). ``CHUNK`` places are one window; what earlier chunks hold is carried to the later ones,
    so a key of any length is never one window."""
    chunked = rows.withColumn("_chunk", F.expr(f"{order} div {CHUNK}"))
    direction = F.col(order).desc() if backward else F.col(order).asc()
    inside = Window.partitionBy(key, "_chunk").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    totals = chunked.groupBy(key, "_chunk").agg(*[f(F.col(c)).alias(f"_{n}") for n, (c, f) in values.items()])
    later = F.col("_chunk").desc() if backward else F.col("_chunk").asc()
    before = Window.partitionBy(key).orderBy(later).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_chunk", *[f(F.col(f"_{n}")).over(before).alias(f"_{n}") for n, (c, f) in values.items()]).where(
        " OR ".join(f"_{n} IS NOT NULL" for n in values))
    within = chunked.withColumns({n: f(F.col(c)).over(inside) for n, (c, f) in values.items()})
    joined = within.join(carried, [key, "_chunk"], "left")
    out = {n: F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(
        F.col(n).bitwiseXOR(F.col(f"_{n}")) if f is F.bit_xor else F.col(n) + F.col(f"_{n}")) for n, (c, f) in values.items()}
    return joined.select(*rows.columns, *[x.alias(n) for n, x in out.items()])


class _Runs:
    """Batches sorted by the columns before the last two, cut into runs of equal ones: (key, order, value)."""

    def __init__(self, batches):
        self.batches = batches

    def __iter__(self):
        for batch in self.batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            at = np.flatnonzero(new)
            for s, e in zip(at.tolist(), [*at[1:].tolist(), batch.num_rows], strict=True):
                yield tuple(int(k[s]) for k in keys), batch.slice(s, e - s)


def _end_blocks(batches):
    """Ids of one sequence, in order, as comma-joined texts of at most ENDS ids."""
    names = ["length", "k1", "k2", "first", "ids"]
    out: list[tuple] = []
    for key, run in _Runs(batches):
        ids = run.column(3).to_pylist()
        out += [(*key, ids[i], ",".join(map(str, ids[i:i + ENDS]))) for i in range(0, len(ids), ENDS)]
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)


def _end_digests(batches):
    """SHA-256 over the blocks of a sequence, which come in order: only the hash state is held."""
    names = ["length", "k1", "k2", "ends_sha256"]
    out: list[tuple] = []
    key, state = None, None
    for k, run in _Runs(batches):
        if k != key:
            if state is not None:
                out.append((*key, state.hexdigest()))
            key, state, lead = k, hashlib.sha256(), b""
        else:
            lead = b","
        for text in run.column(4):
            state.update(lead + bytes(text.as_buffer()))
            lead = b","
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)


def end_lists(ends: DataFrame) -> DataFrame:
    """(length, k1, k2, ends_sha256): SHA-256 of the ascending ids of the conversations that end there, comma-joined.
    The ids are range-partitioned by sequence and id, so a sequence that most conversations share is
    sorted and rendered by many tasks; one task reads its blocks of ``ENDS`` ids in order."""
    n = partitions(ends.sparkSession)
    keys = ["length", "k1", "k2"]
    blocks = ends.select(*keys, "conv").repartitionByRange(n, *keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(
        _end_blocks, "length long, k1 long, k2 long, first long, ids string")
    return blocks.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(
        _end_digests, "length long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """ACTION: the trie of sequences given as (conv, depth, digest, chars), with a row at depth 0 each.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. A node is turn ``depth`` of the rebuilt conversation ``conv_id``. Prefixes are
    told apart by 128 bits. No conversations, no nodes.
    """
    term = lambda seed: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(
        F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")))
    terms = materialize(rebuilt.select("conv", "depth", "chars", term(1).alias("t1"), term(2).alias("t2")), "trie-terms")

    # Whole sequences: weight, and the smallest id stands for all.
    ends = materialize(terms.groupBy("conv").agg(
        F.max("depth").alias("length"), F.bit_xor("t1").alias("k1"), F.bit_xor("t2").alias("k2")), "trie-ends")
    sequences = materialize(ends.groupBy("length", "k1", "k2").agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv")), "trie-sequences")
    prefixes = materialize(_running(terms.join(sequences.select("conv", "weight", "length"), "conv"), "conv", "depth", {
        "p1": ("t1", F.bit_xor), "p2": ("t2", F.bit_xor)}), "trie-prefixes")

    inner = prefixes.where("depth < length").select(*_NODE).distinct()
    leaves = sequences.select("conv", F.col("length").alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2")).join(
        inner, _NODE, "left_anti").select("conv", F.lit(1).alias("leaf"))
    nodes = materialize(prefixes.join(leaves, "conv", "left").groupBy(*_NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("conv"), F.max("chars").alias("chars"), F.max("t1").alias("t1"),
        F.max("t2").alias("t2"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves")).select(
        *_NODE, "n_convs", "conv", "n_leaves", F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("q2"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-nodes")

    # Own chains: the rest below each node, and what a chain adds to every node it passes higher up.
    rest = _running(nodes, "conv", "depth", {"rest": ("saved", F.sum)}, backward=True)
    chains = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("saved").alias("whole"))
    passing = prefixes.join(chains, "conv").where("depth < top").groupBy(*_NODE).agg(F.sum("whole").alias("passing"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("conv").alias("parent_conv_id"))
    listed = end_lists(ends).select(F.col("length").alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "ends_sha256")
    return (rest.join(passing, _NODE, "left").join(children, _NODE, "left").join(listed, _NODE, "left")
            .join(parents, ["depth", "q1", "q2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        (F.col("rest") + F.coalesce("passing", F.lit(0).cast("long"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
