"""The prefix trie of conversations, by hashes of blocks of turns.

Conversations are cut into blocks of ``block`` turns.  Those that begin with the same blocks are grouped by the
digest of all turns up to a block's end, so one row stands for all copies of a block, whatever their number.  Where
all that go on from such a group go on with one and the same block, its turns are single nodes with the group's
members.  Only where siblings diverge are their blocks, counted by members, taken apart turn by turn.

A digest is the exclusive or of 128-bit hashes of (place, role, text), so that of the turns before is had by taking
the last one off, and a conversation of any length is digested in parts.  Sums over subtrees take as many rounds as
the greatest depth has binary digits: round k adds to each node the sums of those 2**k below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.balance import salted_join
from recordloom.operators.ordering import running_sum
from recordloom.session import materialise

BLOCK = 8
PART = 4_096
CHUNK = 512
NODE = ["depth", "d1", "d2"]


def beginning() -> Column:
    return F.struct(*[F.lit(0).cast("bigint").alias(c) for c in NODE])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, size): the turns of each conversation from 1, hashed.

    They are ordered by turn, null first, then by role and text (null: empty); turns equal in all are interchangeable.
    Rows without a conv_id belong to no conversation.
    """
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *text).where("conv_id is not null")
    placed = running_sum(rows, ["conv_id"], ["turn", "role", "text"], "_at")
    return placed.select(
        "conv_id", (F.col("_at") + 1).alias("pos"), F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "text", "role").alias("h2"), F.octet_length("text").cast("bigint").alias("size"))


def shared_beginnings(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv_id, total) in which each conversation c takes the first h turns of c - c % ``every``
    in place of its own first h; h = crc32(c) % ``most``."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("len"))
    taking = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    heads = lengths.select("conv_id", "len", taking.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("head"))
    of_heads = lengths.select(F.col("conv_id").alias("head"), F.col("len").alias("_head_len"))
    taken = F.least("h", F.coalesce("_head_len", F.lit(0)))
    conversations = materialise(heads.join(of_heads, "head", "left").withColumn("taken", taken).withColumn(
        "total", F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))), "conversations")
    # A head serves at most 2 * every - 1 conversations with fewer than ``most`` turns.
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "head").join(
        conversations.select("conv_id", "head", "h"), "head").where("pos <= h").select("conv_id", "pos", "h1", "h2", "size")
    own = salted_join(turns, conversations.select("conv_id", "h", "taken", F.col("len").alias("_n")), "conv_id", F.col("pos"))
    own = own.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", "size")
    return first.union(own), conversations.select("conv_id", "total")


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, size, d1, d2, p1, p2): the digests of all turns up to this one, and of those before it."""
    keyed = turns.select("conv_id", "pos", "size", *[F.xxhash64(h, "pos").alias(x) for h, x in (("h1", "x1"), ("h2", "x2"))],
                         F.floor((F.col("pos") - 1) / PART).alias("part"))
    inside = Window.partitionBy("conv_id", "part").orderBy("pos")
    # Parts after the first start where the ones before end: one row for PART turns.
    ends = keyed.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    long = turns.where(F.col("pos") > PART).select("conv_id").distinct()
    starts = ends.join(long, "conv_id", "left_semi").select(
        "conv_id", "part", *[F.coalesce(F.bit_xor(e).over(before), F.lit(0)).alias(s) for e, s in (("e1", "s1"), ("e2", "s2"))])
    found = keyed.select("*", F.bit_xor("x1").over(inside).alias("r1"), F.bit_xor("x2").over(inside).alias("r2"))
    found = found.join(starts, ["conv_id", "part"], "left")
    for i in "12":
        found = found.withColumn(f"d{i}", F.col(f"r{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0))))
        found = found.withColumn(f"p{i}", F.col(f"d{i}").bitwiseXOR(F.col(f"x{i}")))
    return found.select("conv_id", "pos", "size", "d1", "d2", "p1", "p2")


def node(depth: Column | str, one: str, two: str) -> Column:
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.struct(depth.cast("bigint").alias("depth"), F.col(one).alias("d1"), F.col(two).alias("d2"))


def turn_nodes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, parent, conv_id, n_convs, size) of all nodes but the root; conv_id is the smallest member."""
    placed = turns.withColumn("block", F.floor((F.col("pos") - 1) / block))
    own = placed.groupBy("conv_id", "block").agg(
        F.min_by(node(F.col("pos") - 1, "p1", "p2"), "pos").alias("start"), F.max_by(node("pos", "d1", "d2"), "pos").alias("end"))
    blocks = own.groupBy("block", "start", "end").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    blocks = materialise(blocks, "blocks")
    # How many different blocks follow the same turns; the empty beginning may be followed by most of them.
    next_ = blocks.groupBy("start").agg(F.count("*").alias("_n"))
    asked = salted_join(blocks, next_, "start", F.xxhash64("end")).select("conv_id", "block", "n_convs", "_n")
    spelled = placed.join(asked, ["conv_id", "block"]).select(
        node("pos", "d1", "d2").alias("node"), node(F.col("pos") - 1, "p1", "p2").alias("parent"), "conv_id", "n_convs", "size", "_n")
    refined = spelled.where("_n > 1").groupBy("node").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("size").alias("size"))
    return spelled.where("_n = 1").drop("_n").unionByName(refined)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the hash of the ascending numbers, joined by commas.

    Numbers are joined in chunks all over the cluster; what passes one node's chunks in order is one running hash, so a
    node at which a third of all conversations end needs little memory and one row for CHUNK of them.
    """
    ranked = running_sum(ends, ["node"], ["conv_id"], "_rank")
    chunks = ranked.withColumn("chunk", F.floor(F.col("_rank") / CHUNK)).groupBy("node", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def out(nodes: list) -> pa.RecordBatch:
            names, hashes = zip(*nodes) if nodes else ((), ())
            columns = [pa.array([n[i] for n in names], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            done = []
            keys = zip(*[batch.column(c).to_pylist() for c in NODE])
            for key, ids in zip(keys, batch.column("ids").to_pylist()):
                if key != current:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out(done)
        if current is not None:
            yield out([(current, state.hexdigest())])

    dealt = chunks.select("node.*", "chunk", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    found = dealt.mapInArrow(run, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string")
    return found.select(F.struct(*NODE).alias("node"), "ends_sha256")


def summed_up(nodes: DataFrame, turns: DataFrame, deepest: int) -> DataFrame:
    """Add up ``n_leaves`` and ``saved_tokens`` over subtrees."""
    for k in range(deepest.bit_length()):
        reach = 1 << k
        # The beginning of a node's own smallest conversation, 2**k turns shorter, is its ancestor there.
        above = turns.select("conv_id", (F.col("pos") + reach).alias("_depth"), node("pos", "d1", "d2").alias("_above"))
        below = nodes.where(F.col("node.depth") >= reach).select("node", "conv_id", "n_leaves", "saved_tokens", F.col("node.depth").alias("_depth"))
        lifted = below.join(above, ["conv_id", "_depth"], "left").withColumn("_above", F.coalesce("_above", beginning()))
        added = lifted.groupBy(F.col("_above").alias("node")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        nodes = nodes.join(added, "node", "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("_leaves", F.lit(0)))
        nodes = nodes.withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).drop("_leaves", "_saved")
        nodes = materialise(nodes, "subtrees")
    return nodes


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, pos, h1, h2, size) are numbered from 1 without gaps, ``conversations`` (conv_id, total) names all,
    those without a turn too.  A node is the first ``depth`` turns of conversation ``conv_id``, its smallest member.
    Without a conversation there is no node, not even the root.
    """
    turns = materialise(digested(turns), "turns")
    nodes = materialise(turn_nodes(turns, block), "nodes")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        beginning().alias("node"), F.lit(None).cast(nodes.schema["parent"].dataType).alias("parent"), "conv_id", "n_convs",
        F.lit(0).cast("bigint").alias("size"))
    nodes = nodes.unionByName(root)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("size")
    nodes = materialise(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).select(
        "node", "parent", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        saved.alias("saved_tokens")), "nodes")
    nodes = summed_up(nodes, turns, nodes.agg(F.max("node.depth")).first()[0] or 0)

    ended = turns.join(conversations, "conv_id").where("pos = total").select(node("pos", "d1", "d2").alias("node"), "conv_id").union(
        conversations.where("total = 0").select(beginning().alias("node"), "conv_id"))
    nodes = nodes.join(ends_digest(ended), "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    return salted_join(nodes, above, "parent", F.col("conv_id")).select(
        "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt_trie(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), each begun like the first of its group of ``every``.

    Other columns play no part.  Null roles and texts are empty; rows without a conv_id belong to no conversation; an
    empty table gives no row.
    """
    turns, whole = shared_beginnings(materialise(numbered(conversations), "numbered"), every, most)
    return prefix_trie(turns, whole)
