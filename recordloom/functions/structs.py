"""Nested values: maps of links, locations, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import text as tx

COORDINATES = T.StructType([T.StructField("lang", T.DoubleType()), T.StructField("lat", T.DoubleType())])
LOCATION = T.StructType(
    [
        T.StructField("wilaya", T.StringType()),
        T.StructField("commune", T.StringType()),
        T.StructField("coordinates", COORDINATES),
        T.StructField("fullLocation", T.StringType()),
    ]
)


def clean_map(c: Column) -> Column:
    """Trim the values of a map, drop the empty ones, an empty map becomes null."""
    kept = F.map_filter(
        F.transform_values(c, lambda _, v: tx.optional_text(v.cast("string"))), lambda _, v: v != ""
    )
    return F.when(F.size(kept) > 0, kept)


def _coordinates(lang: Column, lat: Column) -> Column:
    return F.struct(lang.try_cast("double").alias("lang"), lat.try_cast("double").alias("lat"))


def _no_coordinates() -> Column:
    empty = F.lit(None).cast("double")
    return _coordinates(empty, empty)


def build_location(location: Column | None, wilaya: Column, commune: Column) -> Column:
    """Location struct from text columns; null when all of them are empty."""
    w, c = tx.optional_text(wilaya), tx.optional_text(commune)
    joined = F.concat_ws(", ", tx.empty_to_null(w), tx.empty_to_null(c))
    full = joined if location is None else F.coalesce(tx.empty_to_null(tx.optional_text(location)), joined)
    place = F.struct(
        w.alias("wilaya"), c.alias("commune"), _no_coordinates().alias("coordinates"), full.alias("fullLocation")
    )
    return F.when((w != "") | (c != "") | (full != ""), place)


def tidy_location(location: Column, drop_empty: bool = True) -> Column:
    """Tidy a location struct; with ``drop_empty`` one without any text becomes null."""
    w = tx.optional_text(location["wilaya"])
    c = tx.optional_text(location["commune"])
    full = tx.optional_text(location["fullLocation"])
    place = F.struct(
        w.alias("wilaya"),
        c.alias("commune"),
        _coordinates(location["coordinates"]["lang"], location["coordinates"]["lat"]).alias("coordinates"),
        full.alias("fullLocation"),
    )
    present = location.isNotNull()
    return F.when(present & ((w != "") | (c != "") | (full != "")) if drop_empty else present, place)


def tidy_list(c: Column) -> Column:
    """Trim the items of a list, drop the empty ones; an empty list becomes null."""
    kept = F.filter(F.transform(c, lambda item: tx.optional_text(item)), lambda item: item != "")
    return F.when(F.size(kept) > 0, kept)


def tidy_list_text(c: Column) -> Column:
    """Comma separated text -> list of trimmed items; nothing left -> null."""
    text = tx.optional_text(c)
    kept = F.filter(F.transform(F.split(text, ","), lambda item: tx.strip(item)), lambda item: item != "")
    return F.when((text != "") & (F.size(kept) > 0), kept)
