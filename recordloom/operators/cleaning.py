"""Clean every known column of a mapped table in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.config import Settings
from recordloom.functions import dates, fields, structs
from recordloom.functions import text as tx
from recordloom.operators.balance import salted_join
from recordloom.operators.lookup import clean_preferences, fuzzy_lookup


# Columns whose rule starts from normalised text.
TEXT_FIELDS = ["name", "last", "email", "username", "phoneNumber", "DOB", "gender", "description",
               "profilePicture", "preferences", "wilaya", "commune", "userType", "schoolType"]


def _raw_text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.array_join(F.col(name), ",")
    return F.col(name)


def cleaners(df: DataFrame, settings: Settings) -> dict[str, Column]:
    """Field -> cleaned expression over the ``_t_`` columns of normalised text."""
    def t(name: str) -> Column:
        return F.col(f"_t_{name}")

    def dob() -> Column:
        if isinstance(df.schema["DOB"].dataType, T.NumericType):
            return dates.dob_from_number(F.col("DOB"), settings.as_of)
        return dates.dob_from_text(t("DOB"), settings.as_of)

    rules = {
        "name": lambda: fields.name_of(t("name")),
        "last": lambda: fields.name_of(t("last")),
        "email": lambda: fields.email_of(t("email")),
        "username": lambda: fields.username_of(t("username")),
        "phoneNumber": lambda: fields.phone_of(t("phoneNumber"), settings.region, settings.phone_rules),
        "DOB": dob,
        "gender": lambda: fields.gender_label_of(t("gender")),
        "description": lambda: tx.empty_to_null(t("description")),
        "profilePicture": lambda: fields.url_of(t("profilePicture")),
        "preferences": lambda: clean_preferences(t("preferences"), settings.subjects, settings.lookup_threshold),
        "wilaya": lambda: fuzzy_lookup(t("wilaya"), settings.provinces, settings.lookup_threshold),
        "commune": lambda: fields.name_of(t("commune")),
        "userType": lambda: fields.user_type_of(t("userType")),
        "schoolType": lambda: fields.school_type_of(t("schoolType")),
        "verificationType": lambda: tx.text_lower(F.col("verificationType")),
        "blurhash": lambda: tx.optional_text(F.col("blurhash")),
        "_id": lambda: tx.optional_text(F.col("_id")),
    }
    return {name: make() for name, make in rules.items() if name in df.columns}


def gender_from_names(df: DataFrame, names: DataFrame, raw: str, out: str) -> DataFrame:
    """Fill ``out`` from a first-name table (first_name, gender) where the label gave nothing.

    The table is the user's; Spark broadcasts it only when its measured size allows that.
    """
    guess = names.select(
        F.lower("first_name").alias("_first"),
        F.when(F.col("gender").isin("male", "mostly_male"), "male")
        .when(F.col("gender").isin("female", "mostly_female"), "female").alias("_guess"),
    ).groupBy("_first").agg(F.min("_guess").alias("_guess"))
    # Distinct first words meet the table once; rows come back through salts that depend on their own values only.
    wanted = F.when(F.col(out).isNull(), F.lower(F.col(raw)))
    spread = F.xxhash64(*[c for c in ("row_id", raw) if c in df.columns])
    keyed = df.withColumn("_first", F.coalesce(wanted, F.concat(F.lit("\u0001"), F.pmod(spread, F.lit(1_000)).cast("string"))))
    per_word = keyed.where(wanted.isNotNull()).groupBy("_first").agg(F.count("*").alias("_n")).join(guess, "_first")
    joined = salted_join(keyed, per_word, "_first", spread)
    return joined.withColumn(out, F.coalesce(out, "_guess")).drop("_first", "_guess", "_n")


def clean_table(df: DataFrame, settings: Settings | None = None, names: DataFrame | None = None) -> DataFrame:
    """Replace each known column by its cleaned value; other columns stay as they are."""
    settings = settings or Settings()
    by_name = names is not None and "gender" in df.columns
    texts = [tx.normalize_text(_raw_text(df, c), pinned=True).alias(f"_t_{c}") for c in TEXT_FIELDS if c in df.columns]
    done = cleaners(df, settings)
    columns = [done.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]
    if by_name:
        columns.append(F.col("_t_gender").alias("_gender_text"))
    cleaned = df.select("*", *texts).select(*columns)
    if by_name:
        cleaned = gender_from_names(cleaned, names, "_gender_text", "gender").drop("_gender_text")
    if "socialLinks" in df.columns:
        is_map = isinstance(df.schema["socialLinks"].dataType, T.MapType)
        links = structs.clean_map(F.col("socialLinks")) if is_map else F.lit(None).cast("map<string,string>")
        cleaned = cleaned.withColumn("socialLinks", links)
    return _with_location(cleaned)


def _with_location(df: DataFrame) -> DataFrame:
    present = [c for c in ("location", "wilaya", "commune") if c in df.columns]
    if not present:
        return df
    nothing = F.lit(None).cast("string")
    if "location" in present and isinstance(df.schema["location"].dataType, T.StructType):
        return df.withColumn("location", structs.tidy_location(F.col("location"), drop_empty=False))
    place = structs.build_location(
        F.col("location") if "location" in present else None,
        F.col("wilaya") if "wilaya" in present else nothing,
        F.col("commune") if "commune" in present else nothing,
    )
    return df.withColumn("location", place)


def compose_display_name(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """name := "name last" where both columns exist."""
    settings = settings or Settings()
    if "name" not in df.columns or "last" not in df.columns:
        return df
    return fields.with_full_name(df, "name", "last", "name", settings.legacy_compose)
