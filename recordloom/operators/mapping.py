"""From free-text headers to canonical fields."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.config import Settings
from recordloom.functions import text as tx
from recordloom.functions.similarity import best_alias


def header_key(header: str) -> str:
    """Driver-side twin of :func:`recordloom.functions.text.normalize_header` for the alias list."""
    plain = unicodedata.normalize("NFKD", header.replace("\ufffd", " "))
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).lower().split())


def alias_fields(field_aliases: dict[str, list[str]]) -> dict[str, str]:
    """Header alias -> field; a field name is an alias of itself, a later alias wins."""
    return {
        header_key(alias): field
        for field, aliases in field_aliases.items()
        for alias in [field, *aliases]
    }


def name_header_rule(key: Column) -> Column:
    """Header spelled like a first-name or last-name column -> 'name' or 'last'."""
    letters = F.regexp_replace(key, r"[^\p{L}\p{N}]", "")
    return F.when(letters.isin(fv.FIRST_NAME_TOKENS), "name").when(letters.isin(fv.LAST_NAME_TOKENS), "last")


def french_name_rule(headers: DataFrame) -> DataFrame:
    """Add ``family``: the header means the family name because its file also has a first-name column."""
    keyed = headers.withColumn("_key", tx.normalize_header(F.col("header")))
    with_first = keyed.where(F.col("_key").isin(fv.FIRST_NAME_MARKERS)).select("file_id").distinct()
    return (
        keyed.join(with_first.withColumn("_first", F.lit(True)), "file_id", "left")
        .withColumn("family", F.coalesce(F.col("_first"), F.lit(False)) & F.col("_key").isin(fv.FAMILY_NAME_HEADERS))
        .drop("_first")
    )


def map_headers(headers: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(file_id, position, header) -> the same plus field, score and alias; field is null if unmapped."""
    settings = settings or Settings()
    fields = alias_fields(settings.field_aliases)
    key = F.col("_key")
    ruled = french_name_rule(headers).withColumn("_rule", name_header_rule(key)).withColumn(
        "_equal", tx.map_value(fields, key) if fields else F.lit(None).cast("string")
    )
    open_key = F.when(
        ~F.col("family") & F.col("_rule").isNull() & F.col("_equal").isNull() & (F.length(key) > 3), key
    )
    near = ruled.withColumn("_near", best_alias(open_key, list(fields)))
    position, score = F.col("_near.position"), F.col("_near.score")
    names = tx.lit_list(list(fields.values()))
    aliases = tx.lit_list(list(fields))
    accepted = score >= settings.mapping_threshold
    return near.select(
        "file_id",
        "position",
        "header",
        F.when(F.col("family"), "last")
        .when(F.col("_rule").isNotNull(), F.col("_rule"))
        .when(F.col("_equal").isNotNull(), F.col("_equal"))
        .when(accepted, F.try_element_at(names, position + 1)).alias("field"),
        F.when(F.col("family"), 100.0)
        .when(F.col("_rule").isNotNull(), 99.0)
        .when(F.col("_equal").isNotNull(), 100.0)
        .otherwise(F.coalesce(score, F.lit(0.0))).alias("score"),
        F.when(F.col("family"), "french_name_rule")
        .when(F.col("_rule").isNotNull(), "name_header_heuristic")
        .when(F.col("_equal").isNotNull(), key)
        .otherwise(F.coalesce(F.try_element_at(aliases, position + 1), F.lit(""))).alias("alias"),
    )


def mapping_audit(mapped: DataFrame) -> DataFrame:
    """One row per accepted mapping."""
    return mapped.where("field is not null").select(
        "file_id",
        "position",
        F.col("header").alias("original_column"),
        F.col("field").alias("mapped_column"),
        "score",
        F.col("alias").alias("matched_alias"),
    )


def collapse(columns: list[Column]) -> Column:
    """First non-empty value from the left, '' when there is none."""
    return F.coalesce(*[tx.empty_to_null(c) for c in columns], F.lit(""))


def map_columns(
    df: DataFrame, settings: Settings | None = None, keep: tuple[str, ...] = ("row_id",)
) -> tuple[DataFrame, DataFrame]:
    """Rename the columns of one table; also return the audit.  Columns in ``keep`` are left alone.

    Only the headers of the table are collected, never its rows.
    """
    spark = df.sparkSession
    raw = [name for name in df.columns if name not in keep]
    headers = spark.createDataFrame(
        [(0, i, name) for i, name in enumerate(raw)], "file_id int, position int, header string"
    ).coalesce(1)
    mapped = map_headers(headers, settings)
    decided = {row["position"]: row["field"] for row in mapped.select("position", "field").collect()}
    # Positional names first: two raw headers may differ by case only.
    kept = [F.col(f"`{name}`") for name in df.columns if name in keep]
    plain = df.select(*kept, *[F.col(f"`{name}`") for name in raw])
    plain = plain.toDF(*plain.columns[: len(kept)], *[f"_c{i}" for i in range(len(raw))])
    sources: dict[str, list[int]] = {}
    for i, name in enumerate(raw):
        sources.setdefault(decided[i] or name, []).append(i)
    chosen = [
        (F.col(f"_c{where[0]}") if len(where) == 1 else collapse([F.col(f"_c{i}") for i in where])).alias(name)
        for name, where in sources.items()
    ]
    return plain.select(*plain.columns[: len(kept)], *chosen), mapping_audit(mapped)
