"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Everything is column expressions.  The patterns are possessive, so a text of any length is read in linear time and
without recursion; each is the plain pattern in its comment with the same leftmost matches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,`end`:int,value:string,score:double>"
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, a cheap test that a text can hold one, and words that speak for or against it."""

    name: str
    pattern: str
    hint: str
    prior: float
    likely: str
    unlikely: str = "order|invoice|version|serial|isbn|part no"


# In the order in which spans are listed.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8,
         "mail|contact|write|courriel|correo"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server|adresse"),
    # [0-9]([\x20-]?[0-9])+ ; shorter ones than 13 digits never count, so they are not matched at all
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}", 0.5,
         "card|visa|credit|debit|karte|carte|tarjeta"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax|anruf"),
)
ADDED = (
    # Only the head is consumed; what may follow is looked at, so that a number inside a false one's reach is found too.
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9]))", "[A-Z]{2}[0-9]{2}", 0.5,
         "iban|account|bank|konto|compte|cuenta"),
)
#: Signs of an account number by country.  Other codes may have any length.
IBAN_SIGNS = {code: signs for signs, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for code in codes.split()}
LEAST_SCORE = 0.6


def located(text: Column, kind: Kind) -> Column:
    """All matches with their places in code points: gaps between matches and the matches themselves, summed up."""
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.filter(F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap"))),
                     lambda p: p["value"].isNotNull())
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda done: done["out"])
    return F.when(text.rlike(kind.hint), found).otherwise(nothing)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check: every second digit from the right is doubled, nines cast out, the sum ends in 0."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substr(digits, -place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The ISO 7064 check of an account number: its first four signs go to the end, letters count from 10."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def add(rest: Column, sign: Column) -> Column:
        number = F.when(sign.rlike("[0-9]"), F.ascii(sign) - 48).otherwise(F.ascii(sign) - 55)
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def account_numbers(text: Column, heads: Column) -> Column:
    """The account numbers that begin at ``heads``: the longest run of whole words whose length and checksum hold.

    A number inside an earlier one is none.
    """
    known = F.from_json(F.lit(json.dumps(IBAN_SIGNS)), "map<string,int>")

    def whole(head: Column) -> Column:
        # 34 signs with a space after each; a word cut off there makes more signs than that.
        run = F.regexp_extract(F.substr(text, head["start"] + 1, F.lit(68)), r"^[A-Z0-9]+(?:\x20[A-Z0-9]+)*(?![A-Za-z0-9])", 0)
        words = F.split(run, " ")
        values = F.transform(words, lambda _, i: F.array_join(F.slice(words, 1, i + 1), " "))
        signs = F.try_element_at(known, F.substr(head["value"], F.lit(1), F.lit(2)))

        def holds(value: Column) -> Column:
            compact = F.replace(value, F.lit(" "), F.lit(""))
            return F.when(F.length(compact).between(F.coalesce(signs, F.lit(15)), F.coalesce(signs, F.lit(34))),
                          mod97(compact)).otherwise(False)

        value = F.try_element_at(F.filter(values, holds), F.lit(-1))
        return F.struct(head["start"].alias("start"), (head["start"] + F.length(value)).alias("end"), value.alias("value"))

    found = F.filter(F.transform(heads, whole), lambda s: s["value"].isNotNull())
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.aggregate(found, nothing, lambda done, s: F.when(
        s["start"] < F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)), done).otherwise(F.concat(done, F.array(s))))


def confirmed(kind: Kind, value: Column) -> Column:
    if kind.name == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind.name == "card":
        return F.length(digits_of(value)).between(13, 19) & luhn(digits_of(value))
    if kind.name == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


def scored(text: Column, kind: Kind, span: Column) -> Column:
    """The prior, 0.4 for a checksum, 0.2 for a likely word within CONTEXT code points, less 0.3 for an unlikely one."""
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    around = F.lower(F.concat_ws(" ", F.substr(text, begin + 1, span["start"] - begin),
                                 F.substr(text, span["end"] + 1, F.lit(CONTEXT))))
    checksum = 0.4 if kind.name in ("card", "iban") else 0.0
    return (F.lit(kind.prior + checksum) + F.when(around.rlike(kind.likely), 0.2).otherwise(0.0)
            - F.when(around.rlike(kind.unlikely), 0.3).otherwise(0.0))


def spans_of_kind(text: Column, kind: Kind) -> Column:
    found = located(text, kind)
    good = account_numbers(text, found) if kind.name == "iban" else F.filter(found, lambda s: confirmed(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(
        F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        scored(text, kind, s).alias("score")))


def counted(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def spans_of(text: Column, least_score: float = LEAST_SCORE) -> Column:
    """All spans of a text, by kind as listed and then by place.

    Base kinds stay once confirmed, whatever their score; the others need ``least_score``.
    """
    text = F.coalesce(text, F.lit(""))
    parts = []
    for kind in (*BASE, *ADDED):
        named = spans_of_kind(text, kind)
        parts.append(named if kind in BASE else F.filter(named, lambda s: s["score"] >= least_score))
    return F.concat(*parts).cast(f"array<{SPAN}>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, value, score; code points, end exclusive) per row of ``docs``.

    A null or empty text has none.  Repeated rows are read each; other columns are left out.
    """
    return docs.select("doc_id", spans_of(F.col("text"), least_score).alias("spans"))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    names = [kind.name for kind in BASE]
    counts = [counted(name) for name in names]
    base = listed(F.filter("spans", lambda s: s["kind"].isin(names)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, overlapping ones by the first's.

    ``n_chars``, where there is one, follows the new text.  Texts without a span stay as they are, null included.
    """
    row = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    found = row.withColumn("_spans", F.sort_array(F.transform(
        spans_of(F.col("_text"), least_score),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))

    def step(done: Column, span: Column) -> Column:
        before = F.substr(F.col("_text"), done["at"] + 1, span["start"] - done["at"])
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        parts = F.when(span["start"] >= done["at"], F.concat(done["parts"], F.array(before, mark))).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), parts.alias("parts"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    joined = F.aggregate("_spans", begin, step, lambda done: F.concat(
        F.array_join(done["parts"], ""), F.substr(F.col("_text"), done["at"] + 1)))
    new = found.withColumn("_new", F.when(F.size("_spans") > 0, joined).otherwise(F.col("_text")))
    columns = [F.col("_new").alias("text") if c == "text"
               else F.length("_new").cast("bigint").alias(c) if c == "n_chars" else F.col("_row")[c].alias(c)
               for c in docs.columns]
    return new.select(*columns)
