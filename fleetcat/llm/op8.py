"""MinHash near-duplicate groups: minima, banding, signature check, full-set check, star components.

Method
  1. One pass over the texts makes each document's shingle set, its identity
     (two 64-bit sums over the set, and its size), the bucket keys of its
     ``bands`` bands of ``rows`` universal-hash minima, and a signature of one
     byte per minimum.  Documents with the same set are one class, represented
     by its smallest id, so exact copies never meet in pairs.
  2. Buckets with one representative end here.  In the others each member
     meets one pivot: the most central member (its buckets are the fullest)
     of any of its buckets.  That is one pair per representative.
  3. Pairs are tested on signatures first (estimate at least ``threshold -
     margin``) and then confirmed on the full sets: ``100 * intersection >=
     threshold * union``.  Components of the links follow by alternating
     large-star and small-star.
  4. What the pivots left open is finished exactly.  In a bucket of up to
     ``SMALL`` members, members of different components are tested pairwise.
     In a larger one, members outside its main component are tested against
     all its members, in blocks of bounded size that keep pairs to themselves
     and return links only.  Members of one component need no further test,
     so no link between different texts is lost.

The default 36 bands of 5 rows miss a pair of similarity 0.8 with probability
6e-7; the signature margin (0.15, five standard deviations) adds less.  Hot
pivots are dealt over salts; every step is a written table in the shared
checkpoint folder.

Defined cases: null, empty and blank texts have an empty set and link with
nothing.  Texts with fewer words than a shingle have their whole sequence as
one shingle.  Rows with a null id link with nothing and have a null
component.  Rows that repeat an id are one node, whatever their texts
(``drop_near_duplicates`` makes one of each distinct text); extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcat.llm import words as W
from fleetcat.llm.op7 import prefix_sums
from fleetcat.llm.runtime import map_arrow, written

SHINGLE_WORDS = 5
THRESHOLD = 80  # percent
BANDS, ROWS = 36, 5
MARGIN = 15  # percentage points below the threshold that a signature estimate may lie
SMALL = 16  # members of a bucket that are tested pairwise
BLOCK = 512  # members per side of a block
SALT_ROWS = 512  # pairs of one pivot per salt
SEED = 8


def _signatures(batches, shingle: int, bands: int, rows: int):
    a, b = W.universal(bands * rows, SEED)
    band = np.arange(1, bands + 1, dtype=np.uint64)
    for batch in batches:
        raw, off = W.text_buffer(batch.column(1))
        ids = batch.column(0)
        for i, j in W.slices(off):
            n, k1, k2, keys, sig = [], [], [], [], []
            for s in W.shingle_sets(W.Words(raw, off[i:j + 1]), shingle):
                n.append(len(s))
                k1.append(W.mix64(s + np.uint64(11)).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0)
                k2.append(W.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0)
                if len(s):
                    least = W.minima(s, a, b)
                    key = band
                    for r in range(rows):
                        key = W.mix64(key * np.uint64(0xA24BAED4963EE407) + least[r::rows].astype(np.uint64))
                    keys.append(key.view(np.int64))
                    sig.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "n", "k1", "k2", "keys", "sig"])


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Fixed-width binary values as a matrix of bytes."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]].reshape(len(col), width)


def _least_matches(least: float, width: int) -> float:
    """Matching bytes of two signatures whose similarity is ``least`` (bytes also agree by chance)."""
    return width * (least + (1 - least) / 256)


def _similar_signatures(batches, width: int, least: float):
    need = _least_matches(least, width)
    for batch in batches:
        if batch.num_rows:
            a, b = _matrix(batch.column(2), width), _matrix(batch.column(3), width)
            keep = np.concatenate([(a[i:i + 4096] == b[i:i + 4096]).sum(axis=1) >= need for i in range(0, len(a), 4096)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _sets(batches, shingle: int):
    for batch in batches:
        raw, off = W.text_buffer(batch.column(1))
        for i, j in W.slices(off):
            sets = list(W.shingle_sets(W.Words(raw, off[i:j + 1]), shingle))
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["node", "items"])


def _block_links(table: pa.Table, width: int, threshold: int, least: float) -> pa.Table:
    """Links between the outsiders (side 0) and the members (side 1) of one block, one per pair of labels."""
    side = np.asarray(table.column("side").combine_chunks())
    node, label = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "label"))
    sig = _matrix(pa.concat_arrays(table.column("sig").chunks), width)
    items = pa.concat_arrays(table.column("items").chunks)
    off, flat = np.asarray(items.offsets), np.asarray(items.values).view(np.uint64)
    sets = [flat[off[k]:off[k + 1]] for k in range(len(side))]
    xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    size = np.diff(off)
    need = _least_matches(least, width)
    linked: dict[int, int] = {}

    def root(x):
        while x in linked:
            x = linked[x]
        return x

    us, vs = [], []
    for x in xs.tolist():
        fits = (label[ys] != label[x]) & (100 * np.minimum(size[ys], size[x]) >= threshold * np.maximum(size[ys], size[x]))
        near = ys[fits]
        near = near[(sig[near] == sig[x]).sum(axis=1) >= need]
        for y in near.tolist():
            a, b = root(int(label[x])), root(int(label[y]))
            if a != b:
                common = W.intersection_size(sets[x], sets[y])
                if 100 * common >= threshold * (len(sets[x]) + len(sets[y]) - common):
                    linked[max(a, b)] = min(a, b)
                    us.append(int(node[x]))
                    vs.append(int(node[y]))
    return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of the edges (u, v): label is the smallest node of its component.

    Alternating large-star and small-star; each round is a written table, and
    rounds end when the edge set stays the same (count and hash sum).
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _similar(pairs: DataFrame, sigs: DataFrame, width: int, least: float) -> DataFrame:
    """The distinct pairs (a, b) that pass the signature test, written."""
    rows = pairs.distinct().join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a") \
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    return written(map_arrow(rows, partial(_similar_signatures, width=width, least=least), "a long, b long"), "similar")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as links (u, v), written; a hot ``a`` is dealt over salts."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia")).join(salts, "a") \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")) \
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
    common = F.size(F.array_intersect("ia", "ib")).cast("long")
    both = right.join(left, ["a", "salt"]).select(
        "a", "b", common.alias("i"), (F.size("ia").cast("long") + F.size("ib")).alias("s"))
    return written(both.where(F.expr(f"100 * i >= {threshold} * (s - i)")).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def _labelled(inside: DataFrame, labels: DataFrame) -> DataFrame:
    return inside.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _blocks(inside: DataFrame, labels: DataFrame, sets: DataFrame, width: int, threshold: int, least: float) -> DataFrame | None:
    """Links between the components that still meet in large buckets; None if there are none to test."""
    now = _labelled(inside.where(f"members > {SMALL}").select("key", "node"), labels)
    sizes = now.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    # one group per main component: its members and the outsiders of all its open buckets, each once
    rows = written(now.join(main.select("key", "main"), "key").select(F.col("main").alias("group"), "node", "label").distinct(), "open")
    if rows.isEmpty():
        return None
    outside = F.col("label") != F.col("group")
    chunks = rows.groupBy("group").agg(F.ceil(F.sum(outside.cast("int")) / BLOCK).cast("int").alias("nx"), F.ceil(F.count("*") / BLOCK).cast("int").alias("ny"))
    rows = rows.join(chunks, "group")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.where(outside).withColumn("x", deal("nx")).withColumn("y", spread("ny")).withColumn("side", F.lit(0))
    y = rows.withColumn("x", spread("nx")).withColumn("y", deal("ny")).withColumn("side", F.lit(1))
    cols = ["group", "x", "y", "side", "node", "label"]
    full = x.select(*cols).union(y.select(*cols)).join(sets, "node")
    links = full.groupBy("group", "x", "y").applyInArrow(lambda t: _block_links(t, width, threshold, least), "u long, v long")
    return written(links, "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, margin: int = MARGIN) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component (smallest id reachable over links)."""
    width, least = bands * rows, (threshold - margin) / 100
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_sigs = written(map_arrow(texts, partial(_signatures, shingle=shingle, bands=bands, rows=rows),
                                 "id long, n long, k1 long, k2 long, keys array<bigint>, sig binary"), "signatures")
    key = ["k1", "k2", "n"]
    small = all_sigs.where("n > 0 and id is not null").select("id", *key)
    classes = small.groupBy(*key).agg(F.min("id").alias("node"))
    member = written(small.distinct().join(classes, key), "classes")
    reps = written(all_sigs.join(member.where("id = node").select("id", *key), ["id", *key])
                   .dropDuplicates(["id", *key]).select(F.col("id").alias("node"), "keys", "sig"), "representatives")

    banded = reps.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("members")) \
        .where("first < last").select("key", "members")
    inside = written(banded.join(buckets, "key").distinct(), "buckets")
    central = inside.groupBy("node").agg(F.sum("members").alias("central"))
    pivots = inside.join(central, "node").groupBy("key").agg(F.max(F.struct("central", (-F.col("node")).alias("p"))).alias("pivot"))
    first = inside.join(pivots, "key").where("node <> -pivot.p").groupBy("node").agg((-F.max("pivot")["p"]).alias("a")) \
        .select("a", F.col("node").alias("b"))
    near = _similar(first, reps, width, least)
    few = inside.where(f"members <= {SMALL}").select("key", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b")
    near_few = _similar(pairs, reps, width, least)
    involved = near.select("a").union(near.select("b")).union(near_few.select("a")).union(near_few.select("b")) \
        .union(inside.where(f"members > {SMALL}").select("node")).distinct()
    sets = written(map_arrow(texts.join(involved.select(F.col("a").alias("id")), "id").select("id", "text"), partial(_sets, shingle=shingle),
                             "node long, items array<bigint>").distinct(), "sets")

    # an id with several sets ties its classes together
    own = member.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w")
    own = member.join(own.select("id", "v"), "id").where("node <> v").select(F.col("node").alias("u"), "v")
    labels = components(_confirmed(near, sets, threshold).union(own))

    tree = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    apart = near_few.join(a, "a", "left").join(b, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
    more = _confirmed(written(apart, "apart"), sets, threshold)
    blocks = _blocks(inside, labels, sets.join(reps.select("node", "sig"), "node"), width, threshold, least)
    more = more if blocks is None else more.union(blocks)
    if not more.isEmpty():
        labels = components(tree.union(more))

    found = member.join(labels, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))
    return all_sigs.select("id", "n").join(found, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id stays.

    Rows that share an id are a node per distinct text, so they are dropped
    only if their texts are equal or near; of equal ones one row stays.  Rows
    without an id are kept.
    """
    node, doc, digest = (f"{x}_{uuid.uuid4().hex}" for x in ("node", "id", "text"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(node, F.col("doc_id").cast("long"))
    if not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # numbers of the distinct (id, text), in the order of the ids
        text = F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit(""))
        nodes = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), text.alias("digest")).distinct()
        nodes = prefix_sums(nodes.withColumn("all", F.lit(0)).withColumn("one", F.lit(1)), "all", ["id", "digest"], "one", "nodes")
        keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(digest, text) \
            .join(nodes.select(F.col("id").alias(doc), F.col("digest").alias(digest), F.col("before").cast("long").alias(node)), [doc, digest], "left")
    found = near_duplicates(keyed.select(F.col(node).alias("node"), "text"), id_col="node", shingle=shingle, threshold=threshold)
    gone = found.groupBy("node").agg(F.min("component_id").alias("c"), F.count("*").alias("rows_of_node")).where(
        "node is not null and (c <> node or rows_of_node > 1)")
    gone = written(gone.select(F.col("node").alias(node), (F.col("c") != F.col("node")).alias("drop")), "dropped")
    left = keyed.join(gone.select(node), node, "left_anti")
    again = keyed.join(gone.where("not drop").select(node), node, "left_semi")
    # equal rows are told apart by their JSON, which any column type has
    once = again.groupBy(node).agg(F.min_by(F.struct(*cols), F.to_json(F.struct(*cols))).alias("row")).select("row.*")
    return left.select(*cols).union(once.select(*cols))
