"""Lookup tables and header aliases from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as tx


def entries_of(df: DataFrame, json_column: str, keep: list[str] | None = None) -> DataFrame:
    """JSON objects -> (keep..., key, value, ord): one row per top-level entry, value as JSON text.

    Text that is not a JSON object gives no rows.
    """
    keep = keep or []
    parsed = F.from_json(F.col(json_column), "map<string,string>", {"mode": "PERMISSIVE"})
    return df.select(
        *keep, F.posexplode(F.map_entries(F.when(F.col(json_column).rlike(r"^\s*\{"), parsed))).alias("ord", "entry")
    ).select(*keep, F.col("entry.key").alias("key"), F.col("entry.value").alias("value"), "ord")


def _texts(value: Column) -> Column:
    """Non-empty strings of a JSON list, [] for anything else."""
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    kept = F.filter(F.transform(listed, lambda a: tx.optional_text(a)), lambda a: a != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def _aliases(value: Column) -> Column:
    nested = F.when(value.startswith("{"), F.get_json_object(value, "$.aliases"))
    return F.when(value.startswith("["), _texts(value)).otherwise(_texts(F.coalesce(nested, F.lit(""))))


def flatten_lookup(entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(key, value, ord) -> (alias, canonical, ord); of two entries for one alias the later one stays.

    A text value is the canonical form of its key; a list, or the list under "aliases", names
    further spellings of the key.
    """
    keep = keep or []
    key, value = tx.optional_text(F.col("key")), F.coalesce(F.col("value"), F.lit(""))
    is_list, is_object = value.startswith("["), value.startswith("{")
    bare = value.rlike(r"^(?:-?\d[\d.eE+-]*|true|false)$")
    text = tx.optional_text(value)
    plain = ~is_list & ~is_object & ~bare

    def pair(alias: Column, canonical: Column) -> Column:
        return F.struct(F.lower(alias).alias("alias"), canonical.alias("canonical"))

    own = pair(key, key)
    of_text = F.when(text != "", F.array(pair(key, text), pair(text, text)))
    of_list = F.concat(F.array(own), F.transform(_aliases(value), lambda a: pair(a, key)))
    # A null value counts as an entry without aliases.
    pairs = F.when(F.col("value").isNull() | bare, F.array(own)).when(plain, of_text).otherwise(of_list)
    exploded = entries.where(key != "").select(*keep, F.col("ord").alias("_o"), F.posexplode(pairs).alias("_p", "_pair"))
    rank = F.struct("_o", "_p")
    return (
        exploded.groupBy(*keep, F.col("_pair.alias").alias("alias"))
        .agg(F.max_by("_pair.canonical", rank).alias("canonical"), F.min(rank).alias("_first"))
        # Spellings keep the place of their first entry, which decides ties between equal scores.
        .select(*keep, "alias", "canonical", F.expr("shiftleft(cast(_first._o as bigint), 32) + _first._p").alias("ord"))
    )


def flatten_field_aliases(entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(key, value, ord) -> (field, aliases, ord)."""
    keep = keep or []
    field = tx.optional_text(F.col("key"))
    return entries.where(field != "").select(
        *keep, field.alias("field"), _aliases(F.coalesce(F.col("value"), F.lit(""))).alias("aliases"), "ord"
    )


def load_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Lookup file -> (alias, canonical, ord); a missing or broken file gives an empty table."""
    return flatten_lookup(entries_of(_whole_text(spark, path), "value"))


def load_field_aliases(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Header alias file -> (field, aliases, ord), with or without a FIELD_ALIASES wrapper."""
    text = _whole_text(spark, path)
    inner = F.get_json_object("value", "$.FIELD_ALIASES")
    if strict:
        text = text.withColumn("_ok", F.assert_true(F.coalesce(inner, "value").rlike(r"^\s*\{"), F.lit(
            "Invalid aliases JSON format. Expected a FIELD_ALIASES dictionary."))).where("_ok is null").drop("_ok")
    chosen = text.withColumn("value", F.when(inner.startswith("{"), inner).otherwise(F.col("value")))
    return flatten_field_aliases(entries_of(chosen, "value"))


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not exists:
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, wholetext=True)


def as_dict(lookup: DataFrame, limit: int) -> dict[str, str]:
    """A lookup small enough to travel with a function; the limit is checked before it is collected."""
    rows = lookup.orderBy("ord").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"lookup has more than {limit} aliases; use match_large_lookup")
    return {r["alias"]: r["canonical"] for r in rows}
