"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it has more than HOT_ROWS rows and more than 1/HOT_SHARE of all, so there are fewer than
# HOT_SHARE hot keys; each is spread over as many salts as keep HOT_ROWS rows in one.
HOT_SHARE = 20_000
HOT_ROWS = 50_000


def salted_join(rows: DataFrame, per_key: DataFrame, key: str, spread: Column, count: str = "_n") -> DataFrame:
    """Left join ``rows`` with ``per_key`` (one row per key, ``count`` = rows of that key).

    Rows of hot keys are spread over salts by ``spread`` (a row identity) and the one matching row is
    repeated for each salt.  The hot-key table has fewer than ``HOT_SHARE`` rows by construction, which
    is why it may be broadcast.
    """
    total = per_key.agg(F.sum(count)).scalar()
    hot = per_key.where((F.col(count) > HOT_ROWS) & (F.col(count) > total / HOT_SHARE)).select(
        key, F.ceil(F.col(count) / HOT_ROWS).cast("bigint").alias("_salts"))
    one = F.lit(1).cast("bigint")
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", one))).drop("_salts")
    salted_keys = per_key.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", one) - 1))).drop("_salts")
    return salted_rows.join(salted_keys, [key, "_salt"], "left").drop("_salt")


def tiles(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, tile_rows: int,
          tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides cut into tiles (``key``, ``_i``, ``_j``) of about ``tile_rows`` rows at most; see ``tiled_join``."""
    sizes = left.groupBy(key).agg(F.count("*").alias("_l"), F.lit(0).cast("bigint").alias("_r")).unionByName(
        right.groupBy(key).agg(F.lit(0).cast("bigint").alias("_l"), F.count("*").alias("_r"))
    ).groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    # Only keys that need cutting; Spark broadcasts this table when its measured size allows it.
    large = sizes.where((F.col("_l") > tile_rows) | (F.col("_r") > tile_rows)).where("_l > 0 and _r > 0").select(
        key,
        F.ceil(F.col("_l") / tile_rows).cast("bigint").alias("_lc"),
        F.ceil(F.col("_r") / tile_rows).cast("bigint").alias("_rc"),
    )

    def cut(side: DataFrame, own: str, other: str, identity: str, own_name: str, other_name: str) -> DataFrame:
        sized = side.join(large, key, "left")
        mine = F.pmod(F.xxhash64(identity), F.coalesce(F.col(own), F.lit(1).cast("bigint")))
        theirs = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1).cast("bigint")) - 1)
        tiles = sized.withColumn(own_name, mine).withColumn(other_name, F.explode(theirs)).drop("_lc", "_rc")
        return tiles.repartition(tasks, key, "_i", "_j") if tasks else tiles

    return cut(left, "_lc", "_rc", left_id, "_i", "_j"), cut(right, "_rc", "_lc", right_id, "_j", "_i")


def tiled_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, tile_rows: int,
               tasks: int | None = None) -> DataFrame:
    """Inner equi-join on ``key`` in which no tile meets more than about ``tile_rows`` rows per side.

    A key with more rows is cut into chunks on both sides; every left chunk meets every right chunk in
    exactly one tile, so the result is that of the plain join.  The two sides share no column but ``key``.  Tiles are
    dealt over ``tasks`` where given; otherwise Spark chooses by the bytes of the rows, whatever the pairs are.
    """
    first, second = tiles(left, right, key, left_id, right_id, tile_rows, tasks)
    return first.join(second, [key, "_i", "_j"]).drop("_i", "_j")
