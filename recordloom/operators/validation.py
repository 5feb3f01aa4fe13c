"""Validation and the target record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import fixed_values as fv
from recordloom.config import Settings
from recordloom.functions import dates, fields, structs
from recordloom.functions import text as tx
from recordloom.session import materialise

TARGET = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("phoneNumber", T.StringType()),
        T.StructField("location", structs.LOCATION),
        T.StructField("profilePicture", T.StringType()),
        T.StructField("socialLinks", T.MapType(T.StringType(), T.StringType())),
        T.StructField("verificationType", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("preferences", T.ArrayType(T.StringType())),
        T.StructField("blurhash", T.StringType()),
        T.StructField("userType", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("schoolType", T.StringType()),
        T.StructField("DOB", T.LongType()),
        T.StructField("gender", T.StringType()),
    ]
)


def filled(c: Column) -> Column:
    return tx.empty_to_null(tx.optional_text(c))


def allowed_value(c: Column, values: list[str]) -> Column:
    text = tx.optional_text(c)
    return F.when(text.isin(values), text)


def resolve_user_type(user_type: Column, school_type: Column, last: Column, name: Column) -> Column:
    return F.coalesce(
        allowed_value(user_type, fv.ALLOWED_USER_TYPES),
        F.when(allowed_value(school_type, fv.ALLOWED_SCHOOL_TYPES).isNotNull(), "school"),
        F.when((tx.optional_text(last) != "") | (tx.optional_text(name) != ""), "student"),
    )


def missing_fields(required: dict[str, Column]) -> Column:
    """Names of the required fields that have no value, in order."""
    return F.array_compact(F.array(*[F.when(tx.strip(F.coalesce(c, F.lit(""))) == "", F.lit(n)) for n, c in required.items()]))


def revalidate_dob(seconds: Column, settings: Settings) -> Column:
    """Stored seconds are kept; the older range lost births before May 1970."""
    if settings.legacy_dob_range:
        return dates.dob_from_number(seconds, settings.as_of)
    return seconds.cast("bigint")


def derived_last(name: Column) -> Column:
    """Last word of a name of two words or more."""
    words = F.split(tx.squeeze(name), " ")
    return F.when(F.size(words) >= 2, F.element_at(words, -1))


def _get(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(TARGET[name].dataType)


def build_records(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Add ``record`` (the target struct) and ``failure_reason`` (null if the record is valid)."""
    settings = settings or Settings()
    # Names of no column of the table, so that none of those is overwritten.
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"

    def own(name: str) -> Column:
        return F.col(mark + name)

    prepared = df.withColumns(
        {
            mark + "kind": resolve_user_type(_get(df, "userType"), _get(df, "schoolType"), _get(df, "last"), _get(df, "name")),
            mark + "school": allowed_value(_get(df, "schoolType"), fv.ALLOWED_SCHOOL_TYPES),
            mark + "given": _get(df, "name"),
            mark + "family": filled(_get(df, "last")),
            mark + "email": filled(_get(df, "email")),
            mark + "username": filled(_get(df, "username")),
            mark + "picture": F.coalesce(filled(_get(df, "profilePicture")), F.lit(settings.default_picture)),
        }
    )
    prepared = fields.with_full_name(prepared, mark + "given", mark + "family", mark + "name", settings.legacy_compose, fallback_to_last=True)
    prepared = prepared.withColumn(mark + "last", F.coalesce(mark + "family", derived_last(own("name"))))
    school = own("kind") == "school"
    required = {"email": own("email"), "name": own("name"), "username": own("username"), "profilePicture": own("picture")}
    lacking = F.when(school, missing_fields(required)).otherwise(missing_fields({**required, "last": own("last")}))
    prepared = prepared.withColumn(mark + "lacking", lacking)
    lacking = own("lacking")
    reason = (
        F.when(own("kind").isNull(), fv.REASON_USER_TYPE)
        .when(school & own("school").isNull(), fv.REASON_SCHOOL_TYPE)
        .when(F.size(lacking) > 0, F.concat(F.lit(fv.REASON_MISSING), F.array_join(lacking, ", ")))
    )
    location = structs.tidy_location(F.col("location")) if _is(df, "location", T.StructType) else F.lit(None).cast(structs.LOCATION)
    links = structs.clean_map(F.col("socialLinks")) if _is(df, "socialLinks", T.MapType) else F.lit(None).cast("map<string,string>")
    if _is(df, "preferences", T.ArrayType):
        preferences = structs.tidy_list(F.col("preferences"))
    else:
        preferences = structs.tidy_list_text(_get(df, "preferences").cast("string"))
    person = ~school
    values = {
        "_id": tx.optional_text(_get(df, "_id")),
        "email": own("email"),
        "name": own("name"),
        "username": own("username"),
        "phoneNumber": filled(_get(df, "phoneNumber")),
        "location": location,
        "profilePicture": own("picture"),
        "socialLinks": links,
        "verificationType": allowed_value(_get(df, "verificationType"), fv.ALLOWED_VERIFICATION),
        "description": tx.optional_text(_get(df, "description")),
        "preferences": preferences,
        "blurhash": tx.optional_text(_get(df, "blurhash")),
        "userType": own("kind"),
        "last": F.when(person, own("last")),
        "schoolType": F.when(school, own("school")),
        "DOB": F.when(person, revalidate_dob(_get(df, "DOB"), settings)),
        "gender": F.when(person, allowed_value(_get(df, "gender"), fv.ALLOWED_GENDERS)),
    }
    record = F.struct(*[v.cast(TARGET[k].dataType).alias(k) for k, v in values.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("failure_reason", "record")]
    return prepared.select(*kept, reason.alias("failure_reason"), record.alias("record"))


def _is(df: DataFrame, name: str, kind: type) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, kind)


@dataclass
class BuildResult:
    valid: DataFrame  # target records
    rejected: DataFrame  # original rows with failure_reason and row_index


def build_split(df: DataFrame, settings: Settings | None = None) -> BuildResult:
    """Valid records and rejected rows; the judged table is written once and read twice."""
    judged = materialise(build_records(df, settings), "judged")
    valid = judged.where("failure_reason is null").select("record.*")
    rejected = judged.where("failure_reason is not null").drop("record").withColumn("row_index", F.col("row_id"))
    return BuildResult(valid, rejected)
