"""Text standardisation as column expressions.

Everything runs in the JVM except Unicode normal forms, which Spark has no function for.  That one
Arrow UDF only receives the values a pattern cannot prove to be in normal form already; every other
row crosses to Python as a null.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import fixed_values as fv

# Characters that no normal form of the compatibility-composed kind ever changes: ASCII, the Latin-1
# letters, the basic Arabic letters, both runs of eastern digits, Arabic punctuation, direction marks.
_NFKC_STABLE = (
    "^[\\x00-\\x7F\u00C0-\u00FF\u0621-\u064A\u0660-\u0669\u06F0-\u06F9\u060C\u061B\u061F\u200E\u200F]*$"
)
_ASCII = r"^[\x00-\x7F]*$"
# Unicode white space plus the four ASCII separators, written out: much faster than a (?U) class.
SPACES = r"[\t-\r\x1C-\x20\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def lit_map(table: dict[str, str]) -> Column:
    """A small dict as a literal map column; the optimizer folds the parsing away."""
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>")


def lit_list(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), "array<string>")


def labels_to_map(table: dict[str, list[str]]) -> dict[str, str]:
    return {label: value for value, labels in table.items() for label in labels}


def map_value(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small dict, null when absent (safe under ANSI mode)."""
    return F.try_element_at(lit_map(table), key)


def _unicode_form(form: str):
    @F.pandas_udf(T.StringType())
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return normalise


def nfkc(c: Column, pinned: bool = False) -> Column:
    form = _unicode_form("NFKC")
    changed = (form.asNondeterministic() if pinned else form)(F.when(~c.rlike(_NFKC_STABLE), c))
    return F.coalesce(changed, c)


def nfkd(c: Column) -> Column:
    changed = _unicode_form("NFKD")(F.when(~c.rlike(_ASCII), c))
    return F.coalesce(changed, c)


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(c, f"{SPACES}+", " "))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not just the space character."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def normalize_text(c: Column, pinned: bool = False) -> Column:
    """Null to '', compatibility composition, western digits, single spaces, trimmed.

    A ``pinned`` column is computed once, however many rules read it; without that the optimizer writes it out in each of them.
    """
    text = nfkc(F.coalesce(c.cast("string"), F.lit("")), pinned)
    return tidy(text)


def tidy(text: Column) -> Column:
    """The part of :func:`normalize_text` after composition; it stays inside generated code."""
    marks = "\u200f\u200e"
    return squeeze(F.translate(text, fv.EASTERN_DIGITS + marks, fv.WESTERN_DIGITS + "  "))


def has_arabic(text: Column) -> Column:
    return text.rlike("[\u0600-\u06FF]")


def _capital_parts(text: Column, separator: str, inner) -> Column:
    return F.array_join(F.transform(F.split(text, separator), inner), separator)


def smart_title(text: Column) -> Column:
    """Capital letter after each space, hyphen and apostrophe, everything else lower case."""
    def capital(part):
        return F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 1_000_000_000))

    def by_apostrophe(part):
        return _capital_parts(part, "'", capital)

    def by_hyphen(part):
        return _capital_parts(part, "-", by_apostrophe)

    return _capital_parts(F.lower(text), " ", by_hyphen)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def display_name(text: Column) -> Column:
    """Names, family names and communes: Arabic script is kept as it is, the rest is title-cased."""
    return F.when(text != "", F.when(has_arabic(text), text).otherwise(smart_title(text)))


def optional_text(c: Column) -> Column:
    """Trimmed text, '' when the value is null or one of the words for "no value"."""
    words = "|".join(w for w in fv.MISSING_WORDS if w)
    edge = SPACES
    return F.regexp_replace(
        F.coalesce(c, F.lit("")), rf"^{edge}*(?i:{words})?{edge}*$|^{edge}+|{edge}+$", ""
    )


def is_missing_word(c: Column) -> Column:
    return optional_text(c) == ""


def text_lower(c: Column) -> Column:
    return F.lower(empty_to_null(optional_text(c)))


def slugify(c: Column) -> Column:
    """Accents removed, ASCII only, lower case, every other run of characters one underscore."""
    ascii_only = F.regexp_replace(nfkd(c), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9]+", "_"), F.lit("_"))


def normalize_header(c: Column) -> Column:
    """Header text for comparison: no replacement characters, no accents, lower case, single spaces."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\ufffd", " ")
    return squeeze(F.lower(F.regexp_replace(nfkd(text), r"\p{M}", "")))


def last_word(c: Column) -> Column:
    """Last white-space separated token of a non-empty text."""
    return F.element_at(F.split(squeeze(c), " "), -1)


def first_word(c: Column) -> Column:
    return F.element_at(F.split(squeeze(c), " "), 1)
