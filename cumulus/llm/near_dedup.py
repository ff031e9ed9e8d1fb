"""Near-duplicate documents by SetSketch registers, bands and exact confirmation.

1. Every document becomes its set of word shingles and a SetSketch: per register the minimum of
   exponentially distributed hashes of the set, on a logarithmic scale of base ``B`` and truncated.
   Registers merge by maximum, and two sets agree in one with about the probability of
   their Jaccard similarity. Documents with equal sets form one class from here on.
2. Classes that agree in a whole band of registers share a bucket. No bucket is expanded into
   pairs: its best-connected class is the hub, and every class is compared in full with
   the hubs of its buckets.
3. Links to hubs already make components. A class that misses its hub may still be linked with one of another component. What
   they differ from the hub by decides it: an exact bound on the shared differences and a prefix filter
   over the rarest ones leave few candidate pairs. Their registers are estimated jointly by
   likelihood, and those that may reach the threshold are compared in full.
4. Links make components by label propagation with pointer jumping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.common import text_key
from cumulus.llm.words import run_hashes, word_hashes
from cumulus.session import materialize, releasing

REGISTERS = 100
#: The most that a pair at the threshold may miss every band with (2 in a million at a similarity of 0.8).
MISS = 3e-6
#: SetSketch parameters: base, rate and truncation (16-bit registers).
B, RATE, LEVELS = 1.001, 20.0, 65534
#: Similarity below the threshold that the joint estimate may be off by (about five standard errors).
SLACK = 0.2
_ADDED = np.uint64(0x5851F42D4C957F2D)
_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, size=(2, REGISTERS), dtype=np.uint64)
_SEEDS[1] |= np.uint64(1)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows a band for a threshold: the longest bands that a pair at the threshold misses with at most ``MISS``
    (more similar pairs with less): 25 x 4 at 80 percent, 33 x 3 at 70, 50 x 2 at 50."""
    for rows in range(REGISTERS, 0, -1):
        bands = REGISTERS // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    raise ValueError(f"{REGISTERS} registers do not find pairs of a similarity of {percent} percent")


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words (A-Z lower-cased); a shorter text is one run."""
    words = word_hashes(text.lower())
    if 0 < len(words) < k:
        return run_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(run_hashes(words, k))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), REGISTERS), dtype=np.uint64)
    h = np.empty_like(flat)
    for j in range(REGISTERS):
        np.bitwise_xor(flat, _SEEDS[0, j], out=h)
        np.multiply(h, _SEEDS[1, j], out=h)
        least[:, j] = np.minimum.reduceat(h, at)
    # The least of n uniform hashes gives the least of n exponential ones.
    x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, LEVELS + 1).astype("<u2")


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their registers and set sizes.

    With u, v the sets' shares of na + nb, a register of the first set is higher with probability
    p(u - vJ) and of the second with p(v - uJ), p(x) = -log_B(1 - x (B-1)/B).
    """
    higher, lower = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - higher - lower
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)[None, :]

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = (higher[:, None] * np.log(np.maximum(up, tiny)) + lower[:, None] * np.log(np.maximum(down, tiny))
           + same[:, None] * np.log(np.maximum(1 - up - down, tiny)))
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketch_rows(k: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(bytes(t.as_buffer()), k) if t.is_valid else np.zeros(0, np.uint64) for t in part.column(2)]
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "doc_key", "n_shingles", "digest", "sketch"])

    return run


def _set_rows(k: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(bytes(t.as_buffer()), k).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())],
                                                 names=["nid", "sketch", "shingles"])

    return run


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in column]


def _intersections(batches):
    for batch in batches:
        common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
        na, nb = ([len(x.as_buffer()) // 8 for x in batch.column(i)] for i in (2, 3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (na, nb, common)]],
            names=["a", "b", "na", "nb", "common"])


def _differences(batches):
    """What a class (b) lacks of its hub (a), and what it has besides, marked apart."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = [np.concatenate([np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True) * _ADDED])
                   for a, b in zip(_sets(part.column(2)), _sets(part.column(3)), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).view(np.int64)))],
                names=["hub", "nid", "parts"])


def _likely(least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column(i)]) for i in (4, 5))
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.concatenate([joint_estimate(a[i:i + 2048], b[i:i + 2048], na[i:i + 2048], nb[i:i + 2048])
                                   for i in range(0, len(na), 2048)]) >= least
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "sa", "sb")


def components(links: DataFrame) -> DataFrame:
    """ACTION (writes the labels of every round): (node, component) for links (a, b) of longs; the
    component is its smallest node. Each round takes the least label among the neighbours and then
    the label's own label, so the rounds grow with the logarithm of a component's diameter."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "near-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label"))
    labels = materialize(labels, "near-labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("m"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = materialize(lower.join(jump, "via").select("node", F.least("via", "far").alias("label"), "old"), "near-labels")
        if after.where("label <> old").limit(1).count() == 0:
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def near_components(classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """ACTION: (nid, component) of the linked classes: every pair at the threshold that shares a
    bucket is linked, directly or through others; pairs that are connected already are not compared."""
    bands, per_band = bands_for(percent)
    banded = classes.select("nid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(
        i.alias("band"), F.xxhash64(F.substring(F.col("sketch"), i * (2 * per_band) + 1, F.lit(2 * per_band))).alias("hash")))).alias("_b")
    ).select("nid", "_b.band", "_b.hash")
    sizes = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(banded.join(sizes, ["band", "hash"]), "near-members")
    degree = members.groupBy("nid").agg(F.sum("size").alias("degree"))
    hubs = members.join(degree, "nid").groupBy("band", "hash").agg(F.max(F.struct("degree", (-F.col("nid")).alias("last"))).alias("_h")).select(
        "band", "hash", (-F.col("_h.last")).alias("a"))
    pairs = materialize(members.join(hubs, ["band", "hash"]).select("a", F.col("nid").alias("b")).where("a <> b").distinct(),
                        "near-pairs")
    needed = classes.join(members.select("nid").distinct(), "nid").select("nid", "sketch", "rep.*")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("doc_key"),
                        F.col(text_col).cast("string").alias("text")).alias("t")
    n = needed.alias("n")
    one = texts.join(n, F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("t.doc_key") == F.col("n.doc_key"))).select(
        "n.nid", "n.sketch", "t.text")
    # Rows that repeat an id and a text give one row here.
    sets = materialize(one.mapInArrow(_set_rows(k), "nid long, sketch binary, shingles binary").dropDuplicates(["nid"]), "near-sets")

    compared = "a long, b long, na long, nb long, common long"
    linked = F.col("common") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    direct = materialize(_with_sets(pairs, sets).mapInArrow(_intersections, compared).withColumn("linked", linked), "near-direct")

    # Components of the links to hubs. Only classes of different components still need a comparison.
    linked_to_hubs = components(direct.where("linked").select("a", "b"))
    label = linked_to_hubs.select(F.col("node").alias("b"), "component")
    apart_from = direct.join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))

    # Hubs with a miss and another component: bound what two classes must share of their differences.
    # 100 + percent times: a link of x and y needs shared >= f(x) + f(y) - slack, f = 100 lacking + percent added;
    # x misses the hub exactly if f(x) > slack, so y shares more than f(y) of its own differences.
    open_hubs = apart_from.groupBy("a").agg(
        F.min("component").alias("one"), F.max("component").alias("other"), F.min(F.col("linked").cast("int")).alias("all")).where(
        "one <> other AND all = 0").select("a")
    apart = apart_from.join(open_hubs, "a").select(
        F.col("a").alias("hub"), F.col("b").alias("nid"), F.col("nb").alias("n"), "linked", "component",
        (100 * (F.col("na") - F.col("common")) + percent * (F.col("nb") - F.col("common"))).alias("f"),
        ((100 - percent) * F.col("na")).alias("slack"))
    parts = _with_sets(direct.join(open_hubs, "a").select("a", "b"), sets).mapInArrow(
        _differences, "hub long, nid long, parts array<long>").select("hub", "nid", F.explode("parts").alias("part"))
    parts = materialize(parts, "near-parts")
    common = parts.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # A part of one class only cannot be shared: it counts in the prefix but needs no row.
    shared = parts.join(common, ["hub", "part"])
    rarest = Window.partitionBy("hub", "nid")
    ranked = shared.withColumn("from_end", F.row_number().over(rarest.orderBy(F.col("times").desc(), F.col("part").desc()))).join(
        apart, ["hub", "nid"])
    up = lambda x: F.ceil(x / (100 + percent))
    # The prefix filter drops the (needed overlap - 1) commonest parts of a class.
    as_y = ranked.where(F.col("from_end") >= F.greatest(F.lit(1), up(F.col("f"))))
    as_x = ranked.where(~F.col("linked") & (F.col("from_end") >= F.greatest(F.lit(1), up(F.col("f") - F.col("slack")))))
    x, y = as_x.alias("x"), as_y.alias("y")
    near = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.part") == F.col("y.part"))
                  & (F.col("x.component") != F.col("y.component"))
                  & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
                  # At a pair's rarest common part, neither has enough commoner ones left for the overlap it needs.
                  & (F.least("x.from_end", "y.from_end") >= up(F.col("x.f") + F.col("y.f") - F.col("x.slack"))))
    found = near.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()
    sized = classes.select("nid", "n_shingles", "sketch")
    both = found.join(sized.select(F.col("nid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka")), "a").join(
        sized.select(F.col("nid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb")), "b").select(
        "a", "b", "na", "nb", "ka", "kb")
    likely = materialize(both.mapInArrow(_likely(percent / 100 - SLACK), "a long, b long"), "near-likely")
    indirect = _with_sets(likely, sets).mapInArrow(_intersections, compared).where(linked)
    # Links across components join them: the same step once more, on one node per component.
    of = lambda name: linked_to_hubs.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    across = indirect.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(across)
    named = joined.select(F.col("node").alias("component"), F.col("component").alias("further"))
    known = linked_to_hubs.join(named, "component", "left").select(
        F.col("node").alias("nid"), F.coalesce("further", "component").alias("component"))
    # A class without a link to a hub is a component of its own there.
    alone = joined.withColumnRenamed("node", "nid").join(linked_to_hubs.withColumnRenamed("node", "nid").select("nid"), "nid", "left_anti")
    return known.union(alone.select("nid", "component"))


def _judged(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """ACTION: the sketched rows, and per digest of a set its component and that one's least id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("doc_key"),
                       F.col(text_col).cast("string").alias("text"))
    with releasing(docs.sparkSession, this_thread=True) as kept:  # what the comparison writes is not needed once the components are
        written = materialize(rows.mapInArrow(
            _sketch_rows(k), "doc_id long, doc_key long, n_shingles long, digest binary, sketch binary"), "near-sketches")
        grouped = written.where("digest IS NOT NULL").groupBy("digest").agg(
            F.min(F.struct("doc_id", "doc_key")).alias("rep"), F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        classes = materialize(grouped.withColumn("nid", F.monotonically_increasing_id()), "near-classes")
        found = near_components(classes, docs, k, percent, id_col, text_col)
        of_class = classes.select("digest", "nid", "least_id").join(found, "nid", "left").select(
            "digest", "least_id", F.coalesce("component", "nid").alias("component"))
        least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = materialize(of_class.join(least, "component").select("digest", "component", "component_id"), "near-components")
        kept += [written, named]
    return written, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """ACTION: components of documents linked by 100 * intersection >= percent * union of their
    sets of distinct k-word shingles. The bands follow from ``percent`` (:func:`bands_for`); below 12 it raises.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than k words is one shingle. Whole texts
    are read. Returns per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable, its own
    included) and ``kept`` (it is the component's id). Texts that are null or without
    words have no shingles and are linked with nothing. Rows that repeat an id, with the same or another text, are
    rows of their own; a null id is passed over as a component's id unless it stands alone.
    """
    written, named = _judged(docs, id_col, text_col, k, percent)
    return written.join(named, "digest", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """ACTION: ``docs`` with exactly one row of each component of :func:`near_duplicates`: the one with the least id
    (a null id comes last), then the least ``text_key``, then the least other columns of equal rows.

    Rows are judged, not ids: another text under a kept id goes if it is a duplicate. Rows whose text is
    null or without words are linked with nothing and all stay, repeated ones too.
    """
    written, named = _judged(docs, id_col, text_col, k, percent)
    judged = written.where("digest IS NOT NULL")
    first = judged.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key")).alias("row"))
    least = first.join(named, "digest").groupBy("component").agg(F.min("row").alias("row")).select("row.doc_id", "row.doc_key")
    copies = judged.groupBy(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).agg(F.count(F.lit(1)).alias("_copies"))
    alone = written.where("digest IS NULL").select("doc_id", "doc_key").distinct().withColumn("_copies", F.lit(1).cast("long"))
    picks = materialize(least.join(copies, least["doc_id"].eqNullSafe(copies["_id"]) & (least["doc_key"] == copies["_key"])).select(
        "_id", "_key", "_copies").union(alone), "near-picks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       text_key(text_col).alias("doc_key"))
    kept = rows.join(picks, rows["doc_id"].eqNullSafe(picks["_id"]) & (rows["doc_key"] == picks["_key"]))
    # Only equal rows are aggregated; they are few, so the texts are not sorted or dealt again.
    equal = kept.where("_copies > 1").groupBy("_id", "_key").agg(F.min("row").alias("row"))
    return kept.where("_copies = 1").select("row.*").union(equal.select("row.*"))
