"""Near-duplicate detection by a signature-coordinate inverted join.

Every set of word shingles gets a MinHash signature of ``coordinates`` values.  Each (coordinate, value) pair is a
posting key.  Two sets whose Jaccard similarity is 0.8 agree in about 80 % of their coordinates, so a pair is a
candidate when it agrees in at least ``matches`` of them.  Keys are ordered by how many sets post under them; a set
with s shared keys posts only under its ``s - matches + collisions`` rarest (the prefix): two sets with enough agreements
must collide ``collisions`` times there.  What is frequent is skipped by that, not cut off.  Sets with fewer than ``matches`` shared keys
can have no partner and leave at once.  Each live set is also folded to ``bits`` bits in which every shingle turns one over: two
such sketches differ in no more bits than the sets differ in shingles, so what they rule out is no link for certain.  What
passes is confirmed on whole shingle sets.

Equal sets are one node from the start.  Inside a posting list each node first meets one pivot; lists of near
copies collapse to one component that way in linear work.  A last exact round meets components that still share a
list: first as a whole, by the distance of one member each less the radii around them and by counting on how many keys
they collide, then the members of the smaller one look at those of the larger one, whatever keys they have.  So no link
between different texts is lost, no list is spelled out within a component and none once for every key.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import Scratch, row_key, small_batches, split_by_keys
from recordloom.llm.components import components
from recordloom.operators.balance import tiled_join
from recordloom.session import materialise

CACHED_WORDS = 300_000
CHUNK = 512
TILE_ROWS = 4_096


@dataclass(frozen=True)
class NearDup:
    """``words`` per shingle, the least similarity in per cent, signature length and agreements asked for.

    With 96 coordinates and 61 agreements a pair at exactly 0.8 is missed with probability 6e-5, one at 0.85 with 6e-8.
    A long signature with a high share of agreements keeps prefixes short, and so chance meetings rare.
    """

    words: int = 5
    percent: int = 80
    coordinates: int = 96
    matches: int = 61
    collisions: int = 4
    bits: int = 1_024
    pivot_rounds: int = 3


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        tokens = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
        if not tokens:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        for token in set(tokens).difference(known):
            known[token] = xxhash.xxh3_64_intdigest(token)
        ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        span = min(self.words, len(ids))
        mixed = ids[: len(ids) - span + 1].copy()
        for at in range(1, span):
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed += ids[at: len(ids) - span + 1 + at]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


class Signer:
    """MinHash signatures; the functions come from a fixed seed."""

    def __init__(self, coordinates: int, seed: int = 20240229):
        draw = random.Random(seed)
        self.masks = np.array([draw.getrandbits(64) for _ in range(coordinates)], np.uint64)[:, None]
        self.factors = np.array([draw.getrandbits(64) | 1 for _ in range(coordinates)], np.uint64)[:, None]

    def least(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.masks), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), CHUNK):
            values = hashes[at: at + CHUNK][None, :] ^ self.masks
            values *= self.factors
            np.minimum(least, values.min(axis=1), out=least)
        return least

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        return (self.least(hashes) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def odd_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` (a power of two) places an odd number of hashes falls on, packed in 64-bit integers.

    What two sets share falls out of the difference of their bits, and every other hash changes one bit at most.
    """
    places = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def signed(docs: DataFrame, how: NearDup) -> DataFrame:
    """(_key, doc_id, n, h1, h2, sig) per document; h1 and h2 name its shingle set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(how.words), Signer(how.coordinates)
        for batch in batches:
            sizes, first, second, signatures = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = shingler.hashes(text.as_py())
                sizes.append(len(hashes))
                if len(hashes):
                    name = xxhash.xxh3_128_digest(hashes.tobytes())
                    first.append(int.from_bytes(name[:8], "little", signed=True))
                    second.append(int.from_bytes(name[8:], "little", signed=True))
                    signatures.append(signer.sign(hashes))
                else:
                    first.append(None), second.append(None), signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))],
                ["_key", "doc_id", "n", "h1", "h2", "sig"])

    small_batches(docs.sparkSession)
    return docs.select("_key", "doc_id", "text").mapInArrow(
        run, "_key bigint, doc_id bigint, n bigint, h1 bigint, h2 bigint, sig array<int>")


def shingle_sets(texts: DataFrame, how: NearDup) -> DataFrame:
    """(node, n, bits, grams) of rows (node, h1, text) whose set is indeed the one that the node names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how.words)
        for batch in batches:
            nodes, bits, grams = [], [], []
            for node, h1, text in zip(batch.column("node"), batch.column("h1"), batch.column("text").cast(pa.binary())):
                hashes = shingler.hashes(text.as_py())
                name = xxhash.xxh3_128_digest(hashes.tobytes())
                if int.from_bytes(name[:8], "little", signed=True) == h1.as_py():
                    nodes.append(node.as_py())
                    bits.append(odd_bits(hashes, how.bits))
                    grams.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(map(len, grams), pa.int64()), pa.array(bits, pa.list_(pa.int64())),
                 pa.array(grams, pa.list_(pa.int64()))],
                ["node", "n", "bits", "grams"])

    small_batches(texts.sparkSession)
    return texts.select("node", "h1", "text").mapInArrow(
        run, "node bigint, n bigint, bits array<bigint>, grams array<bigint>")


def shared_keys(rows: DataFrame, how: NearDup) -> DataFrame:
    """(node, _keys): the keys of a node that another has too, with their frequency, if they are enough for a match."""
    often = rows.groupBy("key").agg(F.count("*").alias("_often")).where("_often > 1")
    # A node has at most ``coordinates`` keys, so the list is bounded.
    own = rows.join(often, "key").groupBy("node").agg(F.collect_list(F.struct("_often", "key")).alias("_keys"))
    return own.where(F.size("_keys") >= how.matches)


def postings(nodes: DataFrame, how: NearDup, scratch: Scratch) -> DataFrame:
    """(key, node, n): each node under the rarest of its shared keys.

    Frequencies are counted twice, first among all nodes and then among those that may still have a partner.
    """
    rows = nodes.select("node", F.posexplode("sig").alias("_c", "_v")).select(
        "node", F.expr("shiftleft(cast(_c as bigint), 32) | (cast(_v as bigint) & 4294967295)").alias("key"))
    first = scratch.keep(shared_keys(rows, how), "shared")
    own = shared_keys(first.select("node", F.explode("_keys.key").alias("key")), how)
    rarest = F.slice(F.sort_array("_keys"), 1, F.size("_keys") - how.matches + how.collisions)
    return own.select("node", rarest["key"].alias("_k")).join(nodes.select("node", "n"), "node").select(
        F.explode("_k").alias("key"), "node", "n")


def similar_size(left: Column, right: Column, how: NearDup) -> Column:
    return F.least(left, right) * 100 >= F.greatest(left, right) * how.percent


def apart(left: str, right: str, how: NearDup) -> Column:
    """In how many bits two packed arrays differ."""
    return sum((F.bit_count(F.get(left, i).bitwiseXOR(F.get(right, i))) for i in range(how.bits // 64)), F.lit(0))


def within(differing: Column, both: Column, how: NearDup) -> Column:
    """Whether sets of ``both`` shingles together that differ in ``differing`` may be similar enough."""
    return differing * (100 + how.percent) <= both * (100 - how.percent)


def confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Pairs (u, v) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("_a"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("_b"))
    united = F.size("_a") + F.size("_b") - F.col("_shared")
    return (
        pairs.join(left, "u").join(right, "v").withColumn("_shared", F.size(F.array_intersect("_a", "_b")))
        .where(F.col("_shared").cast("bigint") * 100 >= united.cast("bigint") * how.percent).select("u", "v")
    )


def open_postings(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings under keys that still hold more than one component, with the component."""
    if labels is None:
        return posts.withColumn("comp", F.col("node"))
    named = posts.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    split = named.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b")
    return named.join(split.select("key"), "key", "left_semi")


def pivot_pairs(posts: DataFrame, sets: DataFrame, seed: int, how: NearDup) -> DataFrame:
    """Each node with the most alike of the pivots of its lists.

    A list's pivot is its node of least hash, seeded by the list, so a node meets many pivots in one round.
    """
    turn = F.xxhash64(F.lit(seed), "key", "node")
    pivots = posts.withColumn("_turn", turn).groupBy("key").agg(
        F.min_by("node", "_turn").alias("v"), F.min_by("n", "_turn").alias("_vn"), F.min_by("comp", "_turn").alias("_vc"))
    met = posts.join(pivots, "key").where(
        (F.col("comp") != F.col("_vc")) & similar_size(F.col("n"), F.col("_vn"), how)
    ).select(F.col("node").alias("u"), "v").distinct()
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("_un"), F.col("bits").alias("_a"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("_vn"), F.col("bits").alias("_b"))
    alike = met.join(left, "u").join(right, "v").withColumn("_apart", apart("_a", "_b", how)).withColumn(
        "_both", F.col("_un") + F.col("_vn")).where(within(F.col("_apart"), F.col("_both"), how))
    return alike.groupBy("u").agg(F.min_by("v", F.struct(F.col("_apart") / F.col("_both"), "v")).alias("v"))


def remaining_pairs(posts: DataFrame, sets: DataFrame, how: NearDup, scratch: Scratch) -> DataFrame:
    """All plausible pairs that share keys and lie in different components, each once.

    Sets that are alike collide on ``collisions`` keys, so their components do; pairs of components that collide on fewer are never
    spelled out.  Of the others each member of the smaller one is written once and looks at the members of the larger one.
    """
    members = posts.select("node", "comp").distinct().join(sets.select("node", "n", "bits"), "node")
    members = scratch.keep(members, "members")
    centres = members.groupBy("comp").agg(F.min_by("bits", "node").alias("_centre"))
    radii = members.join(centres, "comp").groupBy("comp").agg(
        F.max(apart("bits", "_centre", how)).alias("_radius"), F.first("_centre").alias("_centre"), F.count("*").alias("_size"))
    kinds = posts.groupBy("key", "comp").agg(F.min("n").alias("_from"), F.max("n").alias("_to")).join(radii, "comp")
    names = ("comp", "_from", "_to", "_centre", "_radius", "_size")
    left = kinds.select("key", *[F.col(c).alias(f"{c}_a") for c in names])
    right = kinds.select("key", *[F.col(c).alias(f"{c}_b") for c in names])
    reach = (F.col("_to_b") * 100 >= F.col("_from_a") * how.percent) & (F.col("_to_a") * 100 >= F.col("_from_b") * how.percent)
    near = within(apart("_centre_a", "_centre_b", how) - F.col("_radius_a") - F.col("_radius_b"), F.col("_to_a") + F.col("_to_b"), how)
    # What is too far apart as a whole leaves inside the join.
    collided = left.join(right, "key").where((F.col("comp_a") < F.col("comp_b")) & reach & near).select(
        "comp_a", "comp_b", (F.col("_size_a") <= F.col("_size_b")).alias("_smaller"))
    crossed = collided.groupBy("comp_a", "comp_b").agg(F.count("*").alias("_met"), F.first("_smaller").alias("_smaller")).where(
        F.col("_met") >= how.collisions)
    crossed = scratch.keep(crossed.select(
        F.when(F.col("_smaller"), F.col("comp_a")).otherwise(F.col("comp_b")).alias("_own"),
        F.when(F.col("_smaller"), F.col("comp_b")).otherwise(F.col("comp_a")).alias("comp")), "crossed")
    first = members.select(F.col("comp").alias("_own"), F.col("node").alias("u"), F.col("n").alias("_un"), F.col("bits").alias("_ub"))
    second = members.select("comp", F.col("node").alias("v"), F.col("n").alias("_vn"), F.col("bits").alias("_vb"))
    # What the sketches rule out leaves inside this join too.
    met = tiled_join(crossed.join(first, "_own").drop("_own"), second, "comp", "u", "v", TILE_ROWS)
    alike = within(apart("_ub", "_vb", how), F.col("_un") + F.col("_vn"), how)
    return met.where(similar_size(F.col("_un"), F.col("_vn"), how) & alike).select("u", "v")


def link_nodes(docs: DataFrame, nodes: DataFrame, how: NearDup) -> DataFrame | None:
    """(node, label) of all nodes that have a link; None if there is no candidate at all."""
    scratch = Scratch(nodes.sparkSession)
    posts = scratch.keep(postings(nodes, how, scratch), "postings")
    if posts.isEmpty():
        scratch.clear()
        return None
    alive = nodes.join(posts.select("node").distinct(), "node", "left_semi").select("node", "h1", "_rep")
    alive = scratch.keep(alive, "alive")
    # Only texts of live nodes travel; the bitmap in front of the join is bounded.
    near, _ = split_by_keys(docs.select("_key", "text"), alive.select(F.col("_rep").alias("_key")), "_key")
    texts = near.join(alive.withColumnRenamed("_rep", "_key"), "_key")
    sets = scratch.keep(shingle_sets(texts, how).dropDuplicates(["node"]), "sets")

    edges, labels = None, None
    for round_no in range(how.pivot_rounds):
        pairs = pivot_pairs(open_postings(posts, labels), sets, round_no, how)
        found = scratch.keep(confirmed(pairs, sets, how), "links")
        if found.isEmpty():
            break
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
    pairs = remaining_pairs(scratch.keep(open_postings(posts, labels), "open"), sets, how, scratch)
    found = scratch.keep(confirmed(pairs, sets, how), "links")
    if not found.isEmpty():
        labels = components(found if edges is None else edges.union(found))
    scratch.clear()
    return labels


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): _key, doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links.  Null, empty and blank texts have no shingle,
    link with nothing and are their own component.  A null doc_id is never the smallest unless there is no other.
    Repeated rows are equal sets and share a component.  Other columns of ``docs`` play no part.
    """
    docs = docs.select("doc_id", "text").withColumn("_key", row_key(1, "doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    whole = scratch.keep(signed(docs, how), "signed")
    nodes = whole.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("_doc"), F.min("_key").alias("_rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = link_nodes(docs, nodes, how)
    # Signatures are done with; what names documents and sets stays.
    rows = materialise(whole.drop("sig"), "rows")
    nodes = materialise(nodes.drop("sig", "n", "_rep"), "named-sets")
    scratch.clear()
    if labels is None:
        named = nodes.select("h1", "h2", F.col("_doc").alias("_least"), F.col("node").alias("_comp"))
    else:
        grouped = nodes.join(labels, "node", "left").withColumn("_comp", F.coalesce("label", "node"))
        least = grouped.where("label is not null").groupBy("_comp").agg(F.min("_doc").alias("_group_doc"))
        named = grouped.join(least, "_comp", "left").select(
            "h1", "h2", F.coalesce("_group_doc", "_doc").alias("_least"), "_comp")
    return (
        rows.select("_key", "doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(named, ["h1", "h2"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id")))
        .select("_key", "doc_id", "n_shingles", "component_id",
                F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "_comp")
    )


def drop_near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """``docs`` (all its columns) with one document left of each component, the one of smallest doc_id.

    Of repeated rows one stays.  Documents without a shingle stay, as they link with nothing.  Only rows of
    components with more than one row are shuffled; the others pass by.
    """
    found = materialise(near_duplicates(docs, how), "found")
    linked = found.where("n_shingles > 0")
    best = linked.groupBy("_comp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))).alias("_best"), F.count("*").alias("_rows"))
    verdict = materialise(
        linked.join(best.where("_rows > 1"), "_comp").groupBy("_key").agg(
            F.max(F.col("_best._key") == F.col("_key")).alias("_stays")), "verdict")
    keyed = docs.select(row_key(1, "doc_id", "text").alias("_key"), F.struct("*").alias("_row"))
    touched, rest = split_by_keys(keyed, verdict.select("_key"), "_key")
    judged = touched.join(verdict, "_key", "left")
    stay = judged.where("_stays").dropDuplicates(["_key"])
    return rest.select("_row").union(judged.where("_stays is null").select("_row")).union(stay.select("_row")).select("_row.*")
