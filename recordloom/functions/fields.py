"""One column expression per field of a profile.

``*_of`` functions take text that :func:`recordloom.functions.text.normalize_text` made; the
``clean_*`` functions take raw values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx


def name_of(text: Column) -> Column:
    return tx.display_name(text)


def username_of(text: Column) -> Column:
    words = F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", "_")
    return tx.empty_to_null(F.trim(F.regexp_replace(words, "_+", "_"), F.lit("_")))


def email_of(text: Column) -> Column:
    """Lower case, domain spelling fixed, accepted only when the whole address has a valid shape.

    Spaces and dots around the domain go first.  Each step is one pattern on the result of the last.
    """
    address = F.regexp_replace(F.lower(text), r"@[ .]*([^@]*?)[ .]*$", "@$1")
    for right in dict.fromkeys(fv.EMAIL_DOMAIN_FIXES.values()):
        wrong = [w.replace(".", "[.]") for w, r in fv.EMAIL_DOMAIN_FIXES.items() if r == right]
        address = F.regexp_replace(address, rf"@(?:{'|'.join(wrong)})$", f"@{right}")
    return tx.empty_to_null(F.regexp_extract(address, fv.EMAIL_SHAPE, 0))


def phone_of(text: Column, region: str = "DZ", rules: list | None = None) -> Column:
    """First number of the cell in E.164 form when it fits the numbering plan, else null.

    The number may carry the country code (with or without 00) and the trunk prefix.  Plans of other
    regions apply only to numbers written with + or 00.
    """
    rules = rules if rules is not None else fv.PHONE_RULES
    first = F.regexp_extract(text, r"^[^/|;,\u060C]*", 0)
    digits = F.regexp_replace(first, r"\D", "")
    found = []
    for rule_region, code, trunk, pattern in rules:
        national = pattern.removeprefix("^").removesuffix("$")
        home = rule_region == region
        prefix = f"(?:(?:00)?{code})?" if home else f"(?:00)?{code}"
        number = tx.empty_to_null(F.regexp_extract(digits, rf"^{prefix}(?:{trunk})?({national})$", 1))
        number = F.concat(F.lit("+" + code), number)
        found.append(number if home else F.when(first.rlike(r"^[^0-9]*(?:[+]|00)"), number))
    return F.coalesce(*found)


def gender_label_of(text: Column) -> Column:
    return tx.map_value(tx.labels_to_map(fv.GENDER_LABELS), F.lower(text))


def user_type_of(text: Column) -> Column:
    return tx.map_value(tx.labels_to_map(fv.USER_TYPE_LABELS), F.lower(text))


def school_type_of(text: Column) -> Column:
    return tx.map_value(tx.labels_to_map(fv.SCHOOL_TYPE_LABELS), F.lower(text))


def url_of(text: Column) -> Column:
    return F.when(text.startswith("http://") | text.startswith("https://"), text)


def clean_name(c: Column) -> Column:
    return name_of(tx.normalize_text(c))


clean_last = clean_name
clean_commune = clean_name


def clean_username(c: Column) -> Column:
    return username_of(tx.normalize_text(c))


def clean_email(c: Column) -> Column:
    return email_of(tx.normalize_text(c))


def clean_phone(c: Column, region: str = "DZ", rules: list | None = None) -> Column:
    return phone_of(tx.normalize_text(c), region, rules)


def clean_user_type(c: Column) -> Column:
    return user_type_of(tx.normalize_text(c))


def clean_school_type(c: Column) -> Column:
    return school_type_of(tx.normalize_text(c))


def clean_url(c: Column) -> Column:
    return url_of(tx.normalize_text(c))


def clean_free_text(c: Column) -> Column:
    return tx.empty_to_null(tx.normalize_text(c))


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def compose_name(name: Column, last: Column, legacy: bool = False, fallback_to_last: bool = False) -> Column:
    """"name last", or just the name when it ends with the family name already."""
    return compose_texts(
        tx.empty_to_null(tx.optional_text(name)), tx.empty_to_null(tx.optional_text(last)), legacy, fallback_to_last
    )


def compose_texts(name: Column, last: Column, legacy: bool = False, fallback_to_last: bool = False) -> Column:
    """:func:`compose_name` for values that are trimmed, or null when missing.

    The older rule compares only the last word, so a family name of two words was added twice.
    """
    if legacy:
        carries = F.lower(tx.last_word(name)) == F.lower(last)
    else:
        spaced = F.concat(F.lit(" "), F.lower(tx.squeeze(last)))
        carries = F.concat(F.lit(" "), F.lower(tx.squeeze(name))).endswith(spaced)
    whole = F.when(last.isNull() | carries, name).otherwise(F.concat_ws(" ", name, last))
    return F.when(name.isNull(), last if fallback_to_last else F.lit(None).cast("string")).otherwise(whole)


def with_full_name(
    df: DataFrame, name: str, last: str, out: str, legacy: bool = False, fallback_to_last: bool = False
) -> DataFrame:
    """:func:`compose_name` as a column of a table; the trimmed parts are computed once each."""
    parts = {f"_{out}_a": tx.empty_to_null(tx.optional_text(F.col(name))),
             f"_{out}_b": tx.empty_to_null(tx.optional_text(F.col(last)))}
    whole = compose_texts(F.col(f"_{out}_a"), F.col(f"_{out}_b"), legacy, fallback_to_last)
    return df.withColumns(parts).withColumn(out, whole).drop(*parts)
