"""The trie of conversation prefixes, by ROLLUP over positional turn columns.

A turn is known by a digest of role and text. A conversation's turns stand in blocks of
SLOTS columns t0, t1, ...; ROLLUP(prior, t0, t1, ...) aggregates all prefixes of a block
together and grouping_id tells how many columns a group has. `prior` is the key of the
node that the block before ended in, so a conversation of any length goes on in further
blocks and all blocks of all conversations are rolled up in one pass.

The key of a node is an exclusive-or of two 64-bit hashes of (position, turn) over its
path, so keys of blocks come from running totals and a parent's key from its child's.
Sums over subtrees need no walk down the tree: each node belongs to its smallest member,
whose nodes are the end of its path, so a second ROLLUP sums what members own.

Nothing gathers one conversation or one node's members in a task: turns are ranged by
conversation and turn, blocks and nodes are totalled by buckets of a path, a member list
is hashed piece by piece, and parents with over a thousandth of all nodes as children
(fewer than a thousand) are broadcast.

Edge cases: null roles and texts are empty; a null turn comes first; turns of equal number
stand in the order of their digests, repeated rows each count; rows without a conversation
id are left out, since no conversation can be named; conversations of any length are taken
whole; a conversation without turns ends in the root; without any conversation there is
no root, so an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import cut

#: Turn columns of a block, and blocks of a bucket.
SLOTS, BUCKET = 8, 4096
#: A parent with more than this share of all nodes as children is hot.
HOT = 1000
#: Ids of a piece of a member list.
PIECE = 4096
NAMES = [f"t{i}" for i in range(SLOTS)]


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a role and a text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def paths(conversations: DataFrame, borrow: bool = False, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, depth (its number of turns), position, digest and size (bytes of the text) of every turn; a
    conversation without turns has one row without position. borrow: a conversation c with h = crc32(c) % 9
    begins with the first h turns of conversation c - c % 5, if there is one, and goes on
    with its own turns after the first h."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_digest(role_, text_).alias("digest"), F.octet_length(text_).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("row")]
    rows = cut(rows.repartitionByRange(F.asc("conv"), *order).withColumn("part", F.spark_partition_id()))

    base = F.col("conv") - F.col("conv") % 5
    parts = rows.groupBy(base.alias("base"), "conv", "part").agg(F.count("*").alias("n"))
    one, group = Window.partitionBy("base", "conv"), Window.partitionBy("base")
    before = F.coalesce(F.sum("n").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = F.crc32(F.col("conv").cast("string")) % 9 if borrow else F.lit(0).cast("long")
    parts = parts.withColumn("before", before).withColumn("total", F.sum("n").over(one)).withColumn("h", h)
    of_base = F.coalesce(F.max(F.when(F.col("conv") == F.col("base"), F.col("total"))).over(group), F.lit(0))
    parts = parts.withColumn("m", F.least(F.col("h"), of_base)).withColumn("depth", F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    told = F.struct("conv", "depth", "m")
    parts = parts.withColumn("members", F.collect_list(F.when(F.col("before") == 0, told)).over(group))  # at most nine
    parts = parts.select("conv", "part", "before", "h", "m", "depth", F.when(F.col("conv") == F.col("base"), F.col("members")).alias("members"))

    at = rows.join(parts, ["conv", "part"]).withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    target = lambda conv, depth, position: F.struct(conv.alias("conv"), depth.alias("depth"), position.cast("long").alias("position"))
    none = F.array().cast("array<struct<conv:bigint,depth:bigint,position:bigint>>")
    own = F.when(F.col("pos") > F.col("h"), F.array(target(F.col("conv"), F.col("depth"), F.col("pos") - F.col("h") + F.col("m")))).otherwise(none)
    lent = F.transform(F.filter("members", lambda x: x["m"] >= F.col("pos")), lambda x: target(x["conv"], x["depth"], F.col("pos")))
    bare = F.when((F.col("pos") == 1) & (F.col("depth") == 0), F.array(target(F.col("conv"), F.col("depth"), F.lit(None)))).otherwise(none)
    targets = F.concat(own, F.coalesce(lent, none), bare)
    return at.select(F.explode(targets).alias("x"), "digest", "size").select("x.*", "digest", "size")


def _hashes(position: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), position, digest) for seed in (1, 2)]


def _blocks(path_rows: DataFrame) -> DataFrame:
    """conv, depth, bucket, block (a struct of its number and the key of the node before it), the turn
    columns (structs of digest and size), and the key after it."""
    position = F.col("position")
    slot = F.when(position.isNotNull(), F.struct(position.alias("p"), "digest", "size"))
    both = [F.coalesce(F.when(position.isNotNull(), h), F.lit(0).cast("long")) for h in _hashes(position, F.col("digest"))]
    number = F.coalesce(F.floor((position - 1) / SLOTS), F.lit(0)).cast("long")
    rows = path_rows.select("conv", "depth", number.alias("number"), slot.alias("slot"), *(h.alias(f"x{i}") for i, h in enumerate(both)))
    found = rows.groupBy("conv", F.floor(F.col("number") / BUCKET).alias("bucket"), "number").agg(
        F.first("depth").alias("depth"), F.array_sort(F.collect_list("slot")).alias("slots"), *(F.bit_xor(f"x{i}").alias(f"x{i}") for i in (0, 1))
    )
    inside = Window.partitionBy("conv", "bucket").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("*", *(F.coalesce(F.bit_xor(f"x{i}").over(inside), F.lit(0)).alias(f"in{i}") for i in (0, 1)))
    # only conversations of several buckets have something before a bucket
    buckets = found.where(F.col("depth") > SLOTS * BUCKET).groupBy("conv", "bucket").agg(*(F.bit_xor(f"x{i}").alias(f"x{i}") for i in (0, 1)))
    earlier = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("conv", "bucket", *(F.bit_xor(f"x{i}").over(earlier).alias(f"out{i}") for i in (0, 1)))
    found = found.join(buckets, ["conv", "bucket"], "left")
    prior = [F.col(f"in{i}").bitwiseXOR(F.coalesce(F.col(f"out{i}"), F.lit(0))) for i in (0, 1)]
    block = F.struct(F.col("number"), prior[0].alias("k0"), prior[1].alias("k1")).alias("block")
    slots = [F.when(F.size("slots") > i, F.struct(F.get("slots", F.lit(i))["digest"].alias("digest"), F.get("slots", F.lit(i))["size"].alias("size"))).alias(n) for i, n in enumerate(NAMES)]
    return found.select("conv", "depth", "bucket", block, *slots, *(p.bitwiseXOR(F.col(f"x{i}")).alias(f"end{i}") for i, p in enumerate(prior)))


def _rolled(blocks: DataFrame, *values: Column) -> DataFrame:
    """The aggregates of every node: its key k0, k1, its depth and its last turn (null for the root)."""
    found = blocks.rollup("block", *NAMES).agg(*values, F.grouping_id().alias("g"))
    level = F.lit(SLOTS) - F.bit_count("g")
    last = F.get(F.array(*NAMES), (level - 1).cast("int"))
    found = found.where(F.col("block").isNotNull()).withColumn("level", level).withColumn("last", last)
    found = found.where(F.when(F.col("level") == 0, F.col("block.number") == 0).otherwise(F.col("last").isNotNull()))
    keys = [F.col("block.k0"), F.col("block.k1")]
    for i, name in enumerate(NAMES):  # columns rolled up are null
        hashes = _hashes(F.col("block.number") * SLOTS + i + 1, F.col(f"{name}.digest"))
        keys = [k.bitwiseXOR(F.when(F.col(name).isNotNull(), h).otherwise(F.lit(0).cast("long"))) for k, h in zip(keys, hashes, strict=True)]
    return found.select(keys[0].alias("k0"), keys[1].alias("k1"), (F.col("block.number") * SLOTS + F.col("level")).cast("long").alias("depth"), "last", *(c for c in found.columns if c not in ("block", *NAMES, "g", "level", "last")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and conversation -> pieces of each key's list, and its first conversation."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0], len(ids), ",".join(map(str, ids)))], names=["k0", "k1", "first", "n", "told"])

    for batch in batches:
        k0, k1, conv = (batch.column(i).to_numpy() for i in range(3))
        edges = np.flatnonzero((k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])) + 1
        bounds = [0, *edges.tolist(), len(k0)] if len(k0) else [0]
        whole = []  # keys that begin and end in this batch
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            now = (int(k0[a]), int(k1[a]))
            if now != key and ids:
                whole.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            key = now
            ids += conv[a:b].tolist()
            while len(ids) > PIECE:
                rest, ids = ids[PIECE:], ids[:PIECE]
                whole.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
                ids = rest
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*whole, strict=True)], names=["k0", "k1", "first", "n", "told"])
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> the digest of each key's whole list; one hash is open at a time."""
    names = ["k0", "k1", "n_ends", "ends_sha256"]
    key, state, n = None, None, 0
    for batch in batches:
        done = []
        for k0, k1, count, told in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "n", "told")), strict=True):
            if (k0, k1) != key:
                if key is not None:
                    done.append((*key, n, state.hexdigest()))
                key, state, n = (k0, k1), hashlib.sha256(told.encode()), count
            else:
                state.update(b"," + told.encode())
                n += count
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, n, state.hexdigest())], names=names)


def _ends(blocks: DataFrame) -> DataFrame:
    """k0, k1, n_ends and ends_sha256 of the nodes in which conversations end."""
    last = F.col("depth") <= (F.col("block.number") + 1) * SLOTS
    rows = blocks.where(last).select(F.col("end0").alias("k0"), F.col("end1").alias("k1"), "conv")
    rows = rows.repartitionByRange("k0", "k1", "conv").sortWithinPartitions("k0", "k1", "conv")
    pieces = rows.mapInArrow(_pieces, "k0 long, k1 long, first long, n long, told string")
    pieces = pieces.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "first")
    return pieces.mapInArrow(_hashed, "k0 long, k1 long, n_ends long, ends_sha256 string")


def _owned(nodes: DataFrame) -> DataFrame:
    """Adds `below` and `all`: what the smallest member owns from this node on, and in all."""
    rows = nodes.withColumn("bucket", F.floor(F.col("depth") / (SLOTS * BUCKET)))
    inside = Window.partitionBy("conv_id", "bucket")
    rows = rows.withColumn("below", F.sum("w").over(inside.orderBy(F.desc("depth")))).withColumn("all", F.sum("w").over(inside))
    # conversations of one bucket have no other
    several = rows.where(F.col("depth") >= SLOTS * BUCKET).select("conv_id").distinct()
    buckets = rows.join(several, "conv_id", "left_semi").groupBy("conv_id", "bucket").agg(F.sum("w").alias("w"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("conv_id", "bucket", F.coalesce(F.sum("w").over(after), F.lit(0)).alias("later"), F.sum("w").over(Window.partitionBy("conv_id")).alias("every"))
    rows = rows.join(buckets, ["conv_id", "bucket"], "left")
    return rows.withColumn("below", F.col("below") + F.coalesce("later", F.lit(0))).withColumn("all", F.coalesce("every", "all")).drop("bucket", "later", "every")


def trie(path_rows: DataFrame) -> DataFrame:
    """One row per node: node_id, parent_id (null for the root), depth, conv_id (the smallest member),
    parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (bytes
    that members after the first share, summed over its subtree), n_ends and ends_sha256 (of the
    members that end there), and turn (the digest of its last turn)."""
    blocks = cut(_blocks(path_rows))
    nodes = _rolled(blocks, F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    own = [F.when(F.col("depth") > 0, h) for h in _hashes(F.col("depth"), F.col("last.digest"))]
    w = (F.col("n_convs") - 1) * F.coalesce(F.col("last.size"), F.lit(0))
    parents = [F.col(f"k{i}").bitwiseXOR(h).alias(f"q{i}") for i, h in enumerate(own)]
    nodes = cut(nodes.select("k0", "k1", *parents, "depth", "conv_id", "n_convs", w.alias("w"), F.col("last.digest").alias("turn")))
    key = ["k0", "k1"]
    children = nodes.where("depth > 0").groupBy(F.col("q0").alias("k0"), F.col("q1").alias("k1")).agg(F.count("*").alias("n_children"))
    with_children = nodes.join(children, key, "left").fillna(0, ["n_children"])

    owned = _owned(with_children)
    totals = with_children.groupBy("conv_id").agg(F.sum("w").alias("w"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.max("depth").alias("deepest"))
    spread = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("deepest") - 1) / (SLOTS * BUCKET)), F.lit(0).cast("long")))
    totals = totals.select(F.col("conv_id").alias("conv"), "w", "leaf", F.explode(spread).alias("bucket"))
    sums = _rolled(blocks.join(totals, ["conv", "bucket"]), F.sum("w").alias("members"), F.sum("leaf").alias("n_leaves")).select(*key, "members", "n_leaves")
    full = owned.join(sums, key).join(_ends(blocks), key, "left")

    most = nodes.count()
    up = nodes.select(F.col("k0").alias("q0"), F.col("k1").alias("q1"), F.col("conv_id").alias("parent_conv_id"))
    hot = children.where(F.col("n_children") * HOT > most).select(F.col("k0").alias("q0"), F.col("k1").alias("q1"))
    hot = cut(hot.join(up, ["q0", "q1"]))  # fewer than HOT rows, since their children add up to less than all nodes
    rows = full.join(F.broadcast(hot), ["q0", "q1"], "left_anti").join(up, ["q0", "q1"], "left").unionByName(full.join(F.broadcast(hot), ["q0", "q1"]))
    shown = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    return rows.select(
        shown("k0", "k1").alias("node_id"), shown("q0", "q1").alias("parent_id"), "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") + F.col("members") - F.col("all")).alias("saved_tokens"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.lower(F.hex("turn")).alias("turn"),
    )


def with_turns(nodes: DataFrame, conversations: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Adds role and text of each node's last turn; null for the root."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    turns = conversations.select(F.lower(F.hex(turn_digest(role_, text_))).alias("turn"), role_.alias("role"), text_.alias("text")).dropDuplicates(["turn"])
    return nodes.join(turns, "turn", "left")
