"""Even shards that keep linked documents together: groups are dealt whole, by their running sizes.

Documents with equal texts are linked.  Large groups, boundedly many, are packed first: each goes where it fits best,
and one too large for any shard takes as few as hold it.  All other groups stand in one line in hash order, which is
cut into one stretch a shard; a cut moves to the end of the group it falls in where unlinked documents leave the room.
So at most one group a border is split, whatever part of the table is linked, and none with room enough.  Documents
without a link fill what the quotas leave, so counts end at most one apart.  All of it is joins, aggregations and
windows over bounded keys.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import even_rank, row_key
from recordloom.session import materialise

SHARDS = 40
PART_ROWS = 50_000
GROUP = ["_g1", "_g2"]
PIECES = "array<struct<upto:bigint,shard:int>>"


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def packed(sizes: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """Deal groups, the largest first, into ``room``, which shrinks: per group (rows up to, shard) of its pieces.

    A group goes where the least room is left over; one that fits nowhere fills the emptiest shards before that.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        done = 0
        while done < sizes[at]:
            left = sizes[at] - done
            fitting = [s for s, free in enumerate(room) if free >= left]
            shard = min(fitting, key=lambda s: room[s]) if fitting else max(range(len(room)), key=lambda s: room[s])
            taken = min(left, room[shard])
            room[shard] -= taken
            done += taken
            out[at].append((done, shard))
    return out


def even_cuts(total: int, room: list[int]) -> list[int]:
    """Where a line of ``total`` rows is cut so that each shard gets its share by room; the last cut is the end."""
    cuts, so_far, whole = [], 0, max(1, sum(room))
    for free in room:
        so_far += free
        cuts.append(total * so_far // whole)
    return cuts


def moved_cuts(cuts: list[int], room: list[int], split: list[tuple[int, int]]) -> list[int]:
    """Move each cut to the nearer border of the group (begin, end) it splits, or the other, where room allows it.

    The even cut of the next shard stays possible after every move.
    """
    out, last = [], 0
    for shard, cut in enumerate(cuts[:-1]):
        ways = [border for begin, end in split if begin < cut < end for border in (begin, end)]
        able = [way for way in ways if last <= way <= min(last + room[shard], cuts[shard + 1])
                and cuts[shard + 1] - way <= room[shard + 1]]
        last = min(able, key=lambda way: abs(way - cut), default=max(cut, last))
        out.append(last)
    return [*out, cuts[-1]]


def lined_up(groups: DataFrame) -> DataFrame:
    """Add ``_from``: how many rows the groups before have.  Hash buckets are summed alone, then told their start."""
    buckets = max(1, -(-groups.count() // PART_ROWS))
    dealt = groups.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(5), *GROUP), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per PART_ROWS groups.
    starts = dealt.groupBy("_bucket").agg(F.sum("_n").alias("_sum")).withColumn(
        "_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_bucket").orderBy(*GROUP).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_upto", F.sum("_n").over(inside)).join(starts, "_bucket").withColumn(
        "_from", F.col("_start") + F.col("_upto") - F.col("_n")).drop("_bucket", "_upto", "_start")


def split_by(cuts: list[int]) -> Column:
    return F.exists(F.array(*[F.lit(c).cast("bigint") for c in cuts]),
                    lambda c: (c > F.col("_from")) & (c < F.col("_from") + F.col("_n")))


def pieces_of(groups: DataFrame, room: list[int], least: int) -> tuple[DataFrame, int]:
    """(_g1, _g2, _pieces) of all ``groups`` (_g1, _g2, _n), and how many rows those in several pieces have.

    ``room`` shrinks by what the shards take.  Groups of ``least`` rows reach the driver, and one for each cut.
    """
    large = sorted(groups.where(F.col("_n") >= least).collect())
    dealt = packed([row["_n"] for row in large], room)
    in_parts = sum(row["_n"] for row, pieces in zip(large, dealt) if len(pieces) > 1)
    line = materialise(lined_up(groups.where(F.col("_n") < least)), "line")
    total = line.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    cuts = even_cuts(total, room)
    split = [(row["_from"], row["_from"] + row["_n"]) for row in line.where(split_by(cuts)).collect()]
    cuts = moved_cuts(cuts, room, split)
    stretches = [(begin, end, shard) for shard, (begin, end) in enumerate(zip([0, *cuts], cuts)) if end > begin]
    in_parts += sum(end - begin for begin, end in split if any(begin < cut < end for cut in cuts))
    for begin, end, shard in stretches:
        room[shard] -= end - begin

    session = groups.sparkSession
    listed = json.dumps([{"_g1": row["_g1"], "_g2": row["_g2"], "_pieces": [{"upto": u, "shard": s} for u, s in pieces]}
                         for row, pieces in zip(large, dealt)])
    first = session.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<struct<_g1:bigint,_g2:bigint,_pieces:{PIECES}>>")))
    if not stretches:
        return first, in_parts
    all_of = F.array(*[F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(e).cast("bigint").alias("e"), F.lit(s).alias("s"))
                       for b, e, s in stretches])
    end = F.col("_from") + F.col("_n")
    pieces = F.transform(F.filter(all_of, lambda x: (x["e"] > F.col("_from")) & (x["b"] < end)), lambda x: F.struct(
        (F.least(x["e"], end) - F.col("_from")).alias("upto"), x["s"].alias("shard")))
    return first.unionByName(line.select(*GROUP, pieces.cast(PIECES).alias("_pieces"))), in_parts


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs`` (doc_id, text).

    The law is ``rows``: shards hold equally many rows, at most one apart, so ``grown_shard`` is null.  Size is the
    text's bytes plus 16.  Null texts have no group; empty ones are equal texts.  Repeated rows are rows of their
    own in one group.  Reruns agree up to the order of equal rows.  Other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text")).alias("_g1"), F.xxhash64(F.lit(2), "text").alias("_g2"),
        row_key(1, "doc_id", "text").alias("_id")), "rows")
    total = rows.count()
    shares = quotas(total, shards)
    part_rows = max(1, min(PART_ROWS, min(shares) // 4))
    sizes = rows.where("_g1 is not null").groupBy(*GROUP).agg(F.count("*").alias("_n"))
    left = list(shares)
    # Groups of a quarter of a shard: a few for each shard at most.
    pieces, in_parts = pieces_of(materialise(sizes.where("_n > 1"), "groups"), left, max(2, min(shares) // 4))
    grouped = materialise(rows.join(pieces, GROUP, "left"), "grouped")
    whole = grouped.where(F.size("_pieces") == 1).withColumn("_shard", F.col("_pieces")[0]["shard"])
    ranked = even_rank(grouped.where(F.size("_pieces") > 1), GROUP, F.col("_id"), part_rows, in_parts, "_rank")
    cut = ranked.withColumn("_shard", F.filter("_pieces", lambda p: p["upto"] > F.col("_rank"))[0]["shard"])

    room, filled = 0, F.lit(None).cast("int")
    bounds = []
    for shard, free in enumerate(left):
        room += free
        bounds.append((room, shard))
    for bound, shard in reversed(bounds):
        filled = F.when(F.col("_rank") < bound, F.lit(shard)).otherwise(filled)
    single = even_rank(grouped.where("_pieces is null").withColumn("_all", F.lit(0)), ["_all"], F.col("_id"), PART_ROWS,
                       room, "_rank").withColumn("_shard", filled)
    columns = ["doc_id", "size", "text_crc32", "_id", "_shard"]
    placed = whole.select(*columns).unionByName(cut.select(*columns)).unionByName(single.select(*columns))
    slotted = even_rank(placed, ["_shard"], F.col("_id"), PART_ROWS, -(-total // shards), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
                          "slot", F.lit(None).cast("int").alias("grown_shard"))
