"""Fill low-risk missing values.  Present values are never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.config import Settings
from recordloom.functions import dates, fields
from recordloom.functions import text as tx
from recordloom.operators.ordering import running_sum
from recordloom.session import materialise


def is_missing(c: Column) -> Column:
    """Null, NaN, blank or one of the words for "no value"."""
    return tx.is_missing_word(c.cast("string"))


def present(c: Column) -> Column:
    return F.when(~is_missing(c), c)


def row_suffix(row_id: Column, digits: int = 4) -> Column:
    return F.when(row_id.isNull(), "0" * digits).otherwise(
        F.lpad((F.abs(row_id) % (10**digits)).cast("string"), digits, "0")
    )


def _spoken(c: Column) -> Column:
    """Dots and underscores to spaces, digits removed, trimmed."""
    return tx.empty_to_null(tx.strip(F.regexp_replace(F.translate(tx.strip(c), "._", "  "), r"\d+", "")))


def infer_name(email: Column, username: Column) -> Column:
    """Name from the local part of the e-mail, else from the user name."""
    local = F.when(F.contains(email, F.lit("@")), F.substring_index(email, "@", 1))
    return F.coalesce(present(_spoken(local)), present(_spoken(username)))


def infer_last(name: Column) -> Column:
    """Last word of the name (the word itself when there is only one)."""
    return F.when(~is_missing(name), tx.last_word(name))


def username_candidate(name: Column, row_id: Column, digits: int = 4) -> Column:
    """Slug of the first and last word; names without any ASCII letter become user_<row suffix>."""
    words = F.split(tx.squeeze(present(name)), " ")
    ends = F.when(F.size(words) == 1, F.get(words, F.lit(0))).otherwise(
        F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1))
    )
    slug = tx.slugify(ends)
    numbered = F.concat(F.lit("user_"), row_suffix(row_id, digits))
    return F.when(~is_missing(name), F.when(slug.isin("", "user"), numbered).otherwise(slug))


def email_candidate(source: Column, row_id: Column, digits: int = 4) -> Column:
    """Local part of a generated address: slug with dots, a dot, the row suffix."""
    slug = F.coalesce(tx.empty_to_null(tx.slugify(present(source))), F.lit("user"))
    return F.when(
        ~is_missing(source), F.concat_ws(".", F.translate(slug, "_", "."), row_suffix(row_id, digits))
    )


# ---------------------------------------------------------------- unique names


def assign_unique(asks: DataFrame, taken: DataFrame, separator: str) -> DataFrame:
    """Give every (row_id, candidate) a name no one else has.

    Rows are served in row order: the candidate itself if it is free, else candidate + separator + 01,
    02, ...; ``taken`` (column ``name``) lists the names in use before.  The result adds ``given``.

    The sequential rule has a closed form.  The numbers of one candidate that are in use act as extra
    entries in its queue: sort (numbers in use, each lowered by the count of smaller ones) together
    with the rows of the candidate, and the place of a row in that queue is the number it gets.  Both
    steps are running sums over range-partitioned data, so a candidate shared by a third of all rows
    is spread like any other.
    """
    queue = materialise(running_sum(asks.select("row_id", "candidate"), ["candidate"], ["row_id"], "ordinal"), "queue")
    firsts = queue.groupBy("candidate").agg(F.min("row_id").alias("first_row"))
    firsts = materialise(firsts, "firsts")

    # (candidate, number) pairs that are in use: the bare name is number 0.
    pattern = rf"^(.*)[{separator}](\d{{2,}})$"

    def numbers(names: DataFrame) -> DataFrame:
        stem, tail = F.regexp_extract("name", pattern, 1), F.regexp_extract("name", pattern, 2)
        # 01 to 99 have two digits, larger numbers no leading zero.
        proper = (F.length(tail) == 2) & (tail != "00") | (F.length(tail) > 2) & ~tail.startswith("0")
        split = F.when(proper & (F.length(tail) < 18), F.struct(stem.alias("candidate"), tail.cast("bigint").alias("number"), F.col("name")))
        bare = F.struct(F.col("name").alias("candidate"), F.lit(0).cast("bigint").alias("number"), F.col("name"))
        return names.select("*", F.inline(F.array_compact(F.array(bare, split))).alias("candidate", "number", "_name"))

    used = numbers(taken.select("name").where("name is not null").distinct()).drop("_name", "name")
    used = materialise(used.join(firsts.select("candidate"), "candidate", "left_semi"), "used")

    # Candidates that are themselves a numbered form of another candidate.
    stems = numbers(firsts.select(F.col("candidate").alias("name"), "first_row")).where("number > 0").select(
        "candidate", "number", F.col("name").alias("rival"), "first_row"
    )
    clash = stems.join(firsts.select("candidate"), "candidate", "left_semi")
    clash = clash.join(used, ["candidate", "number"], "left_anti")
    if clash.isEmpty():
        return _serve(queue, used, separator)
    clash = materialise(clash, "clash")

    # Who comes first, the rival's first row or the queue of the candidate?  Decisions only depend on
    # smaller numbers and shorter names, so repeating the question settles them one level at a time.
    held = clash.select("candidate", "number", "rival")
    while True:
        blocked = used.unionByName(held.select("candidate", "number")).unionByName(
            clash.join(held, "rival", "left_anti").select(F.col("rival").alias("candidate"), F.lit(0).cast("bigint").alias("number"))
        ).distinct()
        ahead = running_sum(
            blocked.withColumn("_one", F.lit(1)).unionByName(
                clash.join(held, "rival", "left_anti").select("candidate", "number").withColumn("_one", F.lit(0))
            ),
            ["candidate"], ["number"], "below", weight="_one",
        ).select("candidate", "number", "below")
        asked = clash.join(ahead, ["candidate", "number"]).select(
            "candidate", "number", "rival", "first_row", (F.col("number") - F.col("below")).alias("ordinal")
        )
        reach = asked.join(queue.select("candidate", "ordinal", F.col("row_id").alias("claims")), ["candidate", "ordinal"], "left")
        wins = materialise(
            reach.where(F.col("claims").isNull() | (F.col("first_row") < F.col("claims"))).select("candidate", "number", "rival"),
            "wins",
        )
        changed = not (wins.exceptAll(held).isEmpty() and held.exceptAll(wins).isEmpty())
        held = wins
        if not changed:
            return _serve(queue, blocked, separator)


def _serve(queue: DataFrame, blocked: DataFrame, separator: str) -> DataFrame:
    """Number every row past the numbers that are in use."""
    lowered = running_sum(blocked, ["candidate"], ["number"], "smaller").select(
        "candidate", (F.col("number") - F.col("smaller")).alias("at"), F.lit(0).alias("kind"),
        F.col("number").alias("tie"), F.lit(None).cast("bigint").alias("row_id"),
    )
    waiting = queue.select("candidate", F.col("ordinal").alias("at"), F.lit(1).alias("kind"), F.col("ordinal").alias("tie"), "row_id")
    served = running_sum(lowered.unionByName(waiting), ["candidate"], ["at", "kind", "tie"], "number").where("kind = 1")
    number = F.col("number")
    digits = F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    given = F.when(number == 0, F.col("candidate")).otherwise(F.concat(F.col("candidate"), F.lit(separator), digits))
    return served.select("row_id", "candidate", given.alias("given"))


def _unique(df: DataFrame, column: str, candidate: Column, separator: str, ending: str = "") -> DataFrame:
    """(row_id, given): unique names built on ``candidate`` for the rows whose ``column`` is empty.

    Of ``df`` only numbers of rows and the two texts are written, and read three times.
    """
    empty = F.col(column).isNull() | F.lower(tx.strip(F.col(column))).isin("", "nan")
    asked = materialise(df.select("row_id", empty.alias("_empty"), F.when(empty, candidate).otherwise(tx.strip(F.col(column))).alias("text")),
                        f"ask-{column}")
    asks = asked.where("_empty and text is not null").select("row_id", F.col("text").alias("candidate"))
    names = asked.where("not _empty").select(F.col("text").alias("name"))
    if ending:
        names = names.where(F.col("name").endswith(ending)).select(F.expr(f"left(name, length(name) - {len(ending)})").alias("name"))
    given = assign_unique(asks, names, separator).select("row_id", F.concat("given", F.lit(ending)).alias("given"))
    return materialise(given, f"given-{column}")


def _filled(df: DataFrame, given: DataFrame, column: str) -> DataFrame:
    return df.join(given.withColumnRenamed("given", "_given"), "row_id", "left").withColumn(
        column, F.coalesce("_given", column)).drop("_given")


# ---------------------------------------------------------------- the whole step


def infer_table(df: DataFrame, settings: Settings | None = None, names: DataFrame | None = None) -> DataFrame:
    """Fill missing values step by step; each step sees what the earlier ones filled."""
    settings = settings or Settings()
    original = df.columns
    for name in ("name", "last", "username", "email", "profilePicture", "gender", "userType", "schoolType", "phoneNumber"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    if "DOB" not in df.columns:
        df = df.withColumn("DOB", F.lit(None).cast("bigint"))
    c = F.col

    named = df.withColumn("_name", F.coalesce(present(c("name")), infer_name(c("email"), c("username"))))
    # The full name drives the later steps; the table keeps a name it already had.
    named = fields.with_full_name(named, "_name", "last", "_full", settings.legacy_compose)
    named = named.withColumn("name", F.coalesce(present(c("name")), c("_full"))).drop("_name")

    given = _unique(named, "username", username_candidate(c("_full"), c("row_id"), settings.suffix_digits), "_")
    step = _filled(named, given, "username")
    source = F.coalesce(present(c("_full")), c("username"))
    given = _unique(step, "email", email_candidate(source, c("row_id"), settings.suffix_digits), ".", "@" + settings.email_domain)
    step = _filled(step, given, "email")
    step = step.withColumns(
        {
            "last": F.coalesce(present(c("last")), infer_last(c("_full"))),
            "profilePicture": F.coalesce(present(c("profilePicture")), F.lit(settings.default_picture)),
            "userType": F.coalesce(present(c("userType")), F.lit(settings.default_user_type)),
        }
    )
    step = infer_gender(step, "_full", settings, names)
    age = dates.dob_from_age(c("age").cast("string"), settings.as_of) if "age" in original else F.lit(None).cast("bigint")
    phone = F.coalesce(present(c("phoneNumber")), F.lit(settings.placeholder_phone))
    school = F.coalesce(
        present(c("schoolType")), F.when(c("userType") == "school", F.lit(settings.default_school_type))
    )
    return step.withColumns({"DOB": F.coalesce("DOB", age), "phoneNumber": phone, "schoolType": school}).drop("_full")


def infer_gender(df: DataFrame, name: str, settings: Settings, names: DataFrame | None) -> DataFrame:
    """Gender by first name where a name table is given, then the default."""
    df = df.withColumn("gender", present(F.col("gender")))
    if names is not None:
        from recordloom.operators.cleaning import gender_from_names

        df = df.withColumn("_first_word", tx.first_word(F.col(name)))
        df = gender_from_names(df, names, "_first_word", "gender").drop("_first_word")
    return df.withColumn("gender", F.coalesce("gender", F.lit(settings.default_gender)))


