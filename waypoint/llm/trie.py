"""Conversation prefix trie with depth-band rollup.

A node is a distinct sequence of first turns. Its key is the exclusive or of
one 128-bit hash per turn, taken of depth, role and text, so keys of all
prefixes are running values that blocks of turns compute apart and combine; no
conversation has to fit into one task. The node of a key is named by its
smallest member and its depth.

Subtree totals are a depth-band rollup. Depths are cut into bands of HEIGHT
levels. A node's values go to its ancestors inside its band only (at most
HEIGHT rows a node), found through the path of its smallest member. The totals
of the band roots are then completed: band roots form a trie that is HEIGHT
times flatter, so the same step runs on it again, and completed totals go to
the ancestors in the band above. A trie of depth D takes log(D) rounds at base
HEIGHT, and no step makes more than HEIGHT + 1 rows of one node.

The digest of a node's ends is taken over one long text; it is joined in
chunks by range partitions, and one task hashes the chunks of a node as a
stream, holding one chunk at a time.

Defined cases: rows without conv_id belong to no conversation; null role or
text is empty; turns are ordered by turn (null first), role and text, and
repeated rows are repeated turns; a conversation whose rebuilt form has no
turns ends at the root; a table without conversations has no nodes; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.operators.ordered import prefix
from waypoint.session import ship_package

from .common import attach, stage

#: Levels in a band.
HEIGHT = 8
#: Turns whose keys one window computes.
BLOCK = 1024
#: Identifiers in a chunk of a node's ends.
CHUNK = 4096
KEY = ["depth", "k1", "k2"]
TURN = ["conv_id", "depth"]


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, chars): the turns in order, texts as hashes and lengths."""
    filled = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    hashed = filled.select("*", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "text", "role").alias("t2"), F.char_length("text").cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return prefix(hashed, order, by=["conv_id"], rank="place", order_only=["turn", "role", "text"])


def branch_from(own: DataFrame, base: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Every conversation begins with the first ``shared`` turns of conversation ``base``, its own first ``shared`` turns give way.

    Returns the rebuilt turns (conv_id, depth, t1, t2, chars) and all
    conversations (conv_id, turns). ``base`` and ``shared`` are columns over
    conv_id; ``shared`` has to be small, as heads of that length are copied.
    """
    own = stage(own, "turns")
    sizes = own.groupBy("conv_id").agg(F.max("place").alias("turns"))
    convs = sizes.select("conv_id", "turns", base.alias("base"), shared.cast("long").alias("shared"))
    known = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("there"))
    convs = convs.join(known, "base", "left").withColumn("head", F.when(F.col("base") == F.col("conv_id"), F.col("shared")).otherwise(F.least("shared", F.coalesce("there", F.lit(0)))))
    convs = stage(convs, "conversations")
    longest = convs.agg(F.max("shared")).first()[0] or 0
    first = own.where(F.col("place") <= longest).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "t1", "t2", "chars")
    heads = convs.join(first, "base").where("depth <= shared").select("conv_id", "depth", "t1", "t2", "chars")
    rest = attach(own, convs.select("conv_id", "turns", "shared", "head"), ["conv_id"], "turns").where("place > shared")
    rest = rest.select("conv_id", (F.col("place") - F.col("shared") + F.col("head")).alias("depth"), "t1", "t2", "chars")
    return heads.unionByName(rest), convs.select("conv_id", "turns")


def _running(rows: DataFrame, lanes: list[str]) -> DataFrame:
    """``lanes`` become running exclusive ors along each conversation, in blocks of BLOCK turns."""
    top = rows.agg(F.max("depth")).first()[0] or 0
    block = F.floor(F.col("depth") / BLOCK)
    rows = rows.withColumn("block", block)
    along = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select(*[c for c in rows.columns if c not in lanes], *[F.bit_xor(x).over(along).alias(x) for x in lanes])
    if top < BLOCK:
        return inside.drop("block")
    whole = stage(rows.groupBy("conv_id", "block").agg(*[F.bit_xor(x).alias(x) for x in lanes]), "blocks")
    # what a block ends with, less the block itself, is what it starts with
    ends = _running(whole.withColumnRenamed("block", "depth"), lanes).select("conv_id", F.col("depth").alias("block"), *[F.col(x).alias(f"e_{x}") for x in lanes])
    starts = whole.join(ends, ["conv_id", "block"]).select("conv_id", "block", *[F.col(x).bitwiseXOR(F.col(f"e_{x}")).alias(f"b_{x}") for x in lanes])
    kept = [c for c in inside.columns if c not in (*lanes, "block")]
    return inside.join(starts, ["conv_id", "block"]).select(*kept, *[F.col(x).bitwiseXOR(F.col(f"b_{x}")).alias(x) for x in lanes])


def paths(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars): the key of each prefix and of the one before; depth 0 is the root."""
    lanes = rebuilt.select(
        *TURN, "chars", F.xxhash64("depth", "t1", "t2").alias("k1"), F.xxhash64(F.lit("second"), "depth", "t2", "t1").alias("k2")
    )
    own = lanes.select("*", F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    keyed = _running(own, ["k1", "k2"])
    below = keyed.select(*TURN, "k1", "k2", F.col("k1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("s2")).alias("p2"), "chars")
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"), none.alias("p1"), none.alias("p2"), none.alias("chars"))
    return stage(below.unionByName(roots), "paths")


def rollup(nodes: DataFrame, steps: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """Subtree totals of ``values`` per node: (depth, k1, k2, values).

    ``nodes`` has conv_id (any member), depth, k1, k2 and the values; ``steps``
    the paths of those members.
    """
    names = nodes.select(*KEY, "conv_id")
    top = nodes.agg(F.max("depth")).first()[0] or 0
    total = [F.sum(v).alias(v) for v in values]

    def level(rows: DataFrame, width: int) -> DataFrame:
        # only depths that are multiples of width take part; a band holds height of them
        band = F.floor(F.col("depth") / (width * height))
        path = steps.where(F.col("depth") % width == 0).select("conv_id", band.alias("band"), F.col("depth").alias("at"), "k1", "k2")
        here = rows.select("conv_id", band.alias("band"), F.col("depth").alias("own"), *values)
        inner = here.join(path, ["conv_id", "band"]).where("at <= own").groupBy(F.col("at").alias("depth"), "k1", "k2").agg(*total)
        if top < width * height:
            return inner
        inner = stage(inner, "band-totals")
        roots = inner.where(F.col("depth") % (width * height) == 0).join(names, KEY)
        done = stage(level(roots, width * height), "band-roots")
        # a completed root goes to its ancestors in the band above; that root itself is completed already
        sent = done.where("depth > 0").join(names, KEY).select("conv_id", (band - 1).alias("band"), *values)
        inside = path.where(F.col("at") % (width * height) != 0)
        up = sent.join(inside, ["conv_id", "band"]).select(F.col("at").alias("depth"), "k1", "k2", *values)
        below = inner.where(F.col("depth") % (width * height) != 0).select(*KEY, *values)
        return below.unionByName(up).groupBy(*KEY).agg(*total).unionByName(done.select(*KEY, *values))

    return level(nodes, 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) rows as texts of up to CHUNK identifiers of one node."""
    for batch in batches:
        *key, ids = (c.to_pylist() for c in batch.columns)
        keys = list(zip(*key, strict=True))
        out, at = [], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and keys[end] == keys[at] and end - at < CHUNK:
                end += 1
            out.append((*keys[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:4]], pa.array([r[4] for r in out])], [*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each node, which come in order, hashed as one text."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *own, text in zip(*[batch.column(n).to_pylist() for n in KEY], pc.cast(batch.column("ids"), pa.binary()).to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, sha256(text)
            else:
                digest.update(b"," + text)
        if done:
            yield _digest_batch(done)
    if key is not None:
        yield _digest_batch([(*key, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3])], [*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): digest of each node's conv_ids in ascending order, joined by commas."""
    ship_package(ends.sparkSession)
    rows = ends.select(*KEY, "conv_id")
    ordered = rows.repartitionByRange(*rows.columns).sortWithinPartitions(*rows.columns)
    chunks = ordered.mapInArrow(_chunks, "depth long, k1 long, k2 long, first long, ids string")
    placed = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return placed.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(rebuilt: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of ``rebuilt`` (conv_id, depth from 1, t1, t2, chars).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (what the members share with each other, in code
    points, over the subtree), ends_sha256.
    """
    steps = paths(rebuilt, convs)
    members = steps.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"))
    members = stage(members, "members")
    kids = members.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = members.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stage(nodes.select("*", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "nodes")

    totals = rollup(nodes.select(*KEY, "conv_id", "n_leaves", "saved_tokens"), steps, ["n_leaves", "saved_tokens"], height)
    last = steps.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = end_digests(steps.select(*TURN, "k1", "k2").join(last, TURN))
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = attach(nodes.where("depth > 0").select(*KEY, (F.col("depth") - 1).alias("up"), "p1", "p2", "conv_id"), parents, ["up", "p1", "p2"], "n_children")
    found = nodes.select(*KEY, "conv_id", "n_convs", "n_children").join(named.select(*KEY, "parent_conv_id"), KEY, "left").join(totals, KEY, "left").join(ends, KEY, "left")
    none = sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of conversations that branch off the first of their hundred after 0 to 5 turns."""
    base = F.col("conv_id") - F.col("conv_id") % 100
    shared = F.crc32(F.col("conv_id").cast("string")) % 6
    return trie(*branch_from(turns(rows), base, shared), height)
