"""Matching text to a list of known values by equality, then by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.functions.similarity import indel_ratio, near_value, near_values
from recordloom.operators.similar import similar_pairs

# Up to so many aliases equality is decided by a map in the JVM; a longer map would be searched entry by entry, so
# there the worker's dictionary decides it.  The answers are the same.
MAP_ALIASES = 50


def _equal(lookup: dict[str, str], key: Column) -> Column:
    return tx.map_value(lookup, key) if len(lookup) <= MAP_ALIASES else F.lit(None).cast("string")


def fuzzy_lookup(text: Column, lookup: dict[str, str], threshold: float = 85.0) -> Column:
    """Canonical value for normalised text: equal alias, else the nearest one at or above the threshold.

    No shuffle: only the misses are scored, each distinct miss once per Python worker.  The lookup is a dict
    of the driver and travels with the function; for one that is no dict see ``match_large_lookup``.
    """
    if not lookup:
        return F.lit(None).cast("string")
    key = F.lower(text)
    equal = _equal(lookup, key)
    return F.coalesce(equal, near_value(F.when((key != "") & equal.isNull(), key), lookup, threshold))


def split_items(text: Column) -> Column:
    """Items of a multi-value cell, trimmed, without the empty ones."""
    items = F.transform(F.split(text, "[,;/|،]+"), lambda item: F.trim(item))
    return F.filter(items, lambda item: item != "")


def clean_preferences(text: Column, lookup: dict[str, str], threshold: float = 85.0) -> Column:
    """List of canonical items; unknown items are title-cased; repeats (any case) are dropped."""
    if not lookup:
        return F.array().cast("array<string>")
    items = split_items(text)
    equal = F.transform(items, lambda item: _equal(lookup, F.lower(item)))
    unknown = F.zip_with(items, equal, lambda item, known: F.when(known.isNull(), F.lower(item)))
    near = near_values(F.when(F.exists(unknown, lambda item: item.isNotNull()), unknown), lookup, threshold)
    known = F.zip_with(equal, F.coalesce(near, equal), lambda e, n: F.coalesce(e, n))
    chosen = F.zip_with(items, known, lambda item, value: F.coalesce(value, tx.smart_title(item)))

    def keep_first(seen: Column, value: Column) -> Column:
        known = F.exists(seen, lambda s: F.lower(s) == F.lower(value))
        return F.when(known, seen).otherwise(F.concat(seen, F.array(value)))

    return F.aggregate(chosen, F.array().cast("array<string>"), keep_first)


def match_large_lookup(
    values: DataFrame, value: str, lookup: DataFrame, threshold: float = 85.0, tile_rows: int = 4_096
) -> DataFrame:
    """(value, canonical, score) for a lookup DataFrame (alias, canonical, ord) of any size.

    Distinct values only; equality is a plain join.  The misses meet the aliases through the index of rarest letter pairs,
    at every threshold (above 0).
    """
    words = values.select(F.col(value).alias("_text")).where("_text <> ''").distinct()
    known = lookup.where("alias <> ''").groupBy("alias").agg(F.max_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))
    equal = words.join(known, words["_text"] == known["alias"], "left")
    exact = equal.where("alias is not null").select("_text", "canonical", F.lit(100.0).alias("score"))
    one = F.lit("").alias("group")
    missed = equal.where("alias is null").select(one, F.col("_text").alias("text"), F.lit(False).alias("half"))
    near = similar_pairs(missed, known.select(one, F.col("alias").alias("text")), max(threshold, 1.0), tile_rows)
    # A pair is at most as frequent as its alias has near misses; Spark splits what is skewed.
    pairs = near.select(F.col("a").alias("_text"), F.col("b").alias("alias")).join(known, "alias")
    scored = pairs.withColumn("score", indel_ratio(F.col("_text"), F.col("alias"))).where(F.col("score") >= threshold)
    best = scored.groupBy("_text").agg(
        F.max_by(F.struct("canonical", "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b")
    ).select("_text", "b.canonical", "b.score")
    found = exact.unionByName(best)
    return found.withColumnRenamed("_text", value)
