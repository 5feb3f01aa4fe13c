"""Exact and near duplicates.

Exact: rows that share an e-mail and one more strong signal with the first row of that e-mail.
Near: pairs whose weighted similarity of name, phone, date of birth and e-mail reaches a threshold.

No step compares all rows with all rows.  A field whose weight is so large that no pair can reach the
threshold without it is *mandatory*; the mandatory equality field (date of birth, with the default
weights) and the province block become join keys, and what is left is spread over even tiles.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.config import Settings
from recordloom.functions import text as tx
from recordloom.functions.similarity import equality_similarity, field_similarity, tidy_similarity
from recordloom.operators.balance import salted_join, tiled_join, tiles
from recordloom.operators.ordering import dense_index, running_sum
from recordloom.operators.similar import similar_pairs
from recordloom.operators.tiles import NEAR_NAME, NEAR_PHONE, SAME_DATE, SAME_EMAIL, SCHEMA, tile_scores
from recordloom.session import materialise

STRONG_PHONE, STRONG_NAME = 95.0, 92.0
REASON_EMAIL = "exact_email_match"
# Blocks of rows that have a location but no province: one common block.
NO_PROVINCE = "{'wilaya"
SLACK = 1e-9
MOST_DELETIONS = 3
# Fields with a sketch of their letters, and its bits in 64-bit integers.
SKETCHED = {"name": "_ns", "phoneNumber": "_ps", "email": "_es"}
SKETCH_WORDS = 2
SKETCH_PARTS = ["size", *[f"w{i}" for i in range(SKETCH_WORDS)]]
# Pairs of tuples that one task looks at, about.
TASK_PAIRS = 5_000_000
# Keys under which more pairs meet are compared tile by tile in arrays, so many pairs to a task.
DENSE_PAIRS, DENSE_TASK_PAIRS = 20_000, 50_000_000
# The keys of a tuple cost about as much as 50,000 looks in arrays, so cells of up to so many times ``bucket_rows`` are compared in tiles.
ARRAY_TIMES = 5
# Of the points that name and e-mail may lose together, the part that the e-mail index covers.
EMAIL_SHARE = 0.15


def strong_signal(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Near-equal phone, equal date of birth or near-equal name."""
    return (
        (equality_similarity(left["DOB"], right["DOB"]) >= 100.0)
        | (field_similarity(left["phoneNumber"], right["phoneNumber"]) >= STRONG_PHONE)
        | (field_similarity(left["name"], right["name"]) >= STRONG_NAME)
    )


def composite_score(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum in the fixed order name, phone, date of birth, e-mail."""
    return (
        scores["name"] * weights["name"]
        + scores["phoneNumber"] * weights["phoneNumber"]
        + scores["DOB"] * weights["DOB"]
        + scores["email"] * weights["email"]
    )


def block_key(wilaya: Column, structured: Column, text: Column | None = None) -> Column:
    """The province; a sentinel for "structured location but no province"; else the text of a plain one, or ''."""
    known = F.lower(tx.optional_text(wilaya))
    plain = F.lit("") if text is None else F.lower(tx.optional_text(text))
    return F.when(known != "", known).when(structured, NO_PROVINCE).otherwise(plain)


def _match_fields(df: DataFrame) -> DataFrame:
    """Absent match columns are null: they then score 0."""
    kinds = {"name": "string", "phoneNumber": "string", "DOB": "bigint", "email": "string"}
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


# ---------------------------------------------------------------- exact duplicates


@dataclass
class ExactResult:
    flagged: DataFrame  # every input row with the duplicate columns
    email_groups: DataFrame  # (email, number): one row per e-mail with several rows


def exact_email(df: DataFrame, settings: Settings | None = None) -> ExactResult:
    """Add ``_is_duplicate``, ``canonical_row_index`` and the ``_duplicate_*`` columns.

    The first row of each e-mail comes out of an aggregation with map-side combine, so an e-mail that a
    third of all rows share is reduced before it is shuffled, and joins back through salted buckets.  Only
    numbers of rows are written; ``df`` itself is not.
    """
    settings = settings or Settings()
    rows = _match_fields(df).select("row_id", "name", "phoneNumber", "DOB", "email")
    mail = tx.empty_to_null(F.col("email"))
    groups = (
        rows.where(mail.isNotNull())
        .groupBy(mail.alias("_email"))
        .agg(
            F.count("*").alias("_n"),
            F.min("row_id").alias("_first_id"),
            F.min_by(F.struct("name", "phoneNumber", "DOB"), "row_id").alias("_canon"),
        )
        .where("_n > 1")
    )
    numbered = materialise(dense_index(groups, ["_email"], "_number", start=1), "mail-groups")
    # Rows without an e-mail cannot be in a group, so they do not travel.
    joined = salted_join(rows.where(mail.isNotNull()).withColumn("_email", mail), numbered, "_email", F.col("row_id"))
    other = F.col("row_id") != F.col("_first_id")
    fields = ("name", "phoneNumber", "DOB")
    left = {f: F.when(other, F.col(f"_canon.{f}")) for f in fields}
    right = {f: F.when(other, F.col(f)) for f in fields}
    signal = strong_signal(left, right)
    if settings.missing_dob_matches:
        signal = signal | (F.col("DOB").isNull() & F.col("_canon.DOB").isNull())
    found = joined.where(F.col("_first_id").isNotNull() & other & F.coalesce(signal, F.lit(False)))
    duplicates = materialise(found.select("row_id", "_first_id", "_number"), "exact")

    # Only rows of confirmed groups carry anything; the wide table is read as it is and meets these few.
    firsts = duplicates.groupBy(F.col("_first_id").alias("row_id")).agg(F.first("_number").alias("_number")).select(
        "row_id", F.lit(None).cast("bigint").alias("_first_id"), "_number")
    involved = duplicates.union(firsts).select(
        "row_id", group_label(F.col("_number")).alias("_group"), F.col("_first_id").alias("canonical_row_index"))
    flagged = df.join(involved, "row_id", "left").select(
        *df.columns,
        F.coalesce("_group", F.lit("")).alias("_duplicate_group_id"),
        F.when(F.col("_group").isNotNull(), 100.0).otherwise(0.0).alias("_duplicate_score"),
        F.when(F.col("_group").isNotNull(), REASON_EMAIL).otherwise("").alias("_duplicate_reason"),
        F.col("canonical_row_index").isNotNull().alias("_is_duplicate"),
        "canonical_row_index",
    )
    return ExactResult(flagged, numbered.select(F.col("_email").alias("email"), F.col("_number").alias("number")))


def group_label(number: Column) -> Column:
    return F.format_string("dup_%06d", number.cast("bigint"))


# ---------------------------------------------------------------- near duplicates


@dataclass(frozen=True)
class Bounds:
    """What a pair has to satisfy to reach the threshold, derived from the weights alone."""

    weights: dict
    threshold: float

    def least(self, name: str) -> float | None:
        """Least score of a field in any accepted pair; None when the field is not needed."""
        rest = 100.0 * sum(w for other, w in self.weights.items() if other != name)
        if rest >= self.threshold or not self.weights[name]:
            return None
        return (self.threshold - rest) / self.weights[name]

    def needs(self, name: str) -> bool:
        return self.least(name) is not None

    @property
    def loss(self) -> float:
        """Points that the fields of an accepted pair may lose together."""
        return 100.0 * sum(self.weights.values()) - self.threshold

    @property
    def phone_loss(self) -> float:
        """Points up to which a lost phone similarity is looked for under phone keys.

        A pair without e-mail loses no more; where none can be accepted, a third of what there is.
        """
        without_mail = self.loss - 100.0 * self.weights["email"]
        return without_mail if without_mail >= 0 else self.loss / 3

    def least_text(self) -> dict[str, float]:
        """Least similarities of name and e-mail one of which a pair reaches whose phones lose more than ``phone_loss``.

        What is left of the points is dealt over the two, and they cannot both lose more than their part.  Nothing is
        left where phones alone decide.
        """
        left = self.loss - self.phone_loss
        if left <= 0:
            return {}
        parts = {"name": 1 - EMAIL_SHARE, "email": EMAIL_SHARE}
        parts = {name: part for name, part in parts.items() if self.weights[name] > 0}
        return {name: 100.0 - left * part / sum(parts.values()) / self.weights[name] for name, part in parts.items()}

    def phone_distance(self, total: Column) -> Column:
        """Most characters by which phones of ``total`` length together differ when they lose ``phone_loss`` points."""
        return F.floor((self.phone_loss + SLACK) * total / (100.0 * self.weights["phoneNumber"])).cast("int")


def match_rows(df: DataFrame, bounds: Bounds, missing_dob_matches: bool = False) -> DataFrame:
    """(row_id, matched fields, block) of the rows that can be in a pair at all.

    A row that lacks a mandatory field cannot reach the threshold with any other row.
    """
    rows = _match_fields(df)
    plain = "location" in df.columns and isinstance(df.schema["location"].dataType, T.StringType)
    structured = F.col("location").isNotNull() if "location" in df.columns and not plain else F.lit(False)
    wilaya = F.col("wilaya") if "wilaya" in df.columns else F.lit(None).cast("string")
    for name in ("name", "phoneNumber", "email"):
        if bounds.needs(name):
            rows = rows.where(F.trim(name) != "")
    if bounds.needs("DOB") and not missing_dob_matches:
        rows = rows.where(F.col("DOB").isNotNull())
    return rows.select(
        "row_id",
        F.struct(
            F.lower(F.trim("name")).alias("name"),
            F.lower(F.trim("phoneNumber")).alias("phoneNumber"),
            F.col("DOB").cast("string").alias("DOB"),
            F.lower(F.trim("email")).alias("email"),
            block_key(wilaya, structured, F.col("location") if plain else None).alias("block"),
        ).alias("fields"),
    )


def match_tuples(rows: DataFrame) -> DataFrame:
    """Rows that agree in every matched field collapse to one tuple (id = least row id, n = rows).

    Copies are combined before any comparison, however many there are.
    """
    tuples = rows.groupBy("fields").agg(F.min("row_id").alias("id"), F.count("*").alias("n"))
    return tuples.select("id", "n", "fields.*")


def _cells(tuples: DataFrame, bounds: Bounds) -> DataFrame:
    """Join cells: (date of birth, block), and (date of birth, *) where blank blocks meet all others."""
    dob = F.coalesce(F.col("DOB"), F.lit("-")) if bounds.needs("DOB") else F.lit("")
    blank = F.col("block") == ""
    own = F.struct(F.concat_ws("|", dob, F.lit("="), F.col("block")).alias("cell"), F.lit(True).alias("leads"), F.lit(True).alias("own"))
    star = F.struct(F.concat_ws("|", dob, F.lit("*")).alias("cell"), blank.alias("leads"), F.lit(False).alias("own"))
    blanks = materialise(tuples.where(blank).select(star["cell"].alias("_star")).distinct(), "blank-dates")
    if blanks.isEmpty():
        return tuples.select("*", F.inline(F.array(own)))
    # A cell in which no blank block leads has no pair.
    met = tuples.withColumn("_star", star["cell"]).join(blanks.withColumn("_met", F.lit(True)), "_star", "left")
    cells = F.when(blank, F.array(star)).when(F.col("_met"), F.array(own, star)).otherwise(F.array(own))
    return met.select(*tuples.columns, F.inline(cells))


def _deletions(phone: Column, count: int) -> Column:
    """Every text that is left after deleting ``count`` characters."""
    level = F.array(phone)

    def cut(t: Column) -> Column:
        spots = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
        return F.transform(spots, lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))

    for _ in range(count):
        level = F.array_distinct(F.flatten(F.transform(level, cut)))
    return level


def _phone_keys(bounds: Bounds, lengths: Column) -> Column:
    """Keys on which phones meet, one class per length among ``lengths`` that can be near enough.

    Phones of lengths l and m that differ by D characters agree once (D + l - m) / 2 are deleted from the first and
    (D + m - l) / 2 from the second; deleting more of what they share keeps them equal, so the largest D serves all.
    Classes that would need more than MOST_DELETIONS meet as a whole.
    """
    size = F.length("phoneNumber")

    def keys(other: Column) -> Column:
        gap, most = F.abs(size - other), bounds.phone_distance(size + other)
        most = most - (most + gap) % 2  # lengths fix whether the distance is odd
        own, theirs = (most + size - other) / 2, (most + other - size) / 2
        lengths = [F.least(size, other).cast("string"), F.greatest(size, other).cast("string")]
        variants = F.when(F.greatest(own, theirs) > MOST_DELETIONS, F.array(F.lit("*")))
        for count in range(MOST_DELETIONS + 1):
            variants = variants.when(own == count, _deletions(F.col("phoneNumber"), count))
        made = F.transform(variants, lambda v: F.concat_ws("|", F.col("cell"), F.lit("p"), *lengths, v))
        return F.when(gap <= most, made).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(lengths, keys))


def _side(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    """``keys`` and what a pair needs of a tuple, named for one side of it.

    Numbers that decide whether a pair is worth a look stand alone and are never null; all that only the scores read is one column,
    so that a pair is two numbers and two pieces of memory until then.
    """
    def known(value: Column, otherwise) -> Column:
        return F.coalesce(value, F.lit(otherwise))

    flags = {"blank": F.col("block") == "", "filled": F.col("block") != "", "mail": F.col("email_ok")}
    parts = [known(F.col(f"{short}.{part}").cast("bigint"), 0).alias(f"{side}_{short}_{part}")
             for short in SKETCHED.values() for part in SKETCH_PARTS]
    return rows.select(
        *keys, F.col("id").alias(f"{side}_id"), F.struct("n", "name", "phoneNumber", "DOB", "email").alias(side),
        *[known(flag, False).alias(f"{side}_{name}") for name, flag in flags.items()], *parts)


def _similar_in_cells(cells: DataFrame, name: str, least: float, settings: Settings) -> DataFrame:
    """Pairs of tuples of one cell that lead to a similarity of ``least`` or more in the field ``name``."""
    cells = cells.where(F.col(name) != "")
    leads = cells.where("leads").select(F.col("cell").alias("group"), F.col(name).alias("text"), F.col("own").alias("half")).distinct()
    texts = cells.select(F.col("cell").alias("group"), F.col(name).alias("text")).distinct()
    near = similar_pairs(leads, texts, least, settings.tile_rows)
    # In a cell of its own each pair came out once; equal texts meet themselves.
    own = leads.where("half").select("group").distinct()
    turned = near.join(own, "group", "left_semi").select("group", F.col("b").alias("a"), F.col("a").alias("b"))
    equal = leads.select("group", F.col("text").alias("a"), F.col("text").alias("b"))
    near = near.unionByName(turned).unionByName(equal).select(
        F.struct("group", "a").alias("_a"), F.struct("group", "b").alias("_b"))
    first = _side(cells.where("leads").withColumn("_a", F.struct(F.col("cell").alias("group"), F.col(name).alias("a"))), "l", "_a")
    second = _side(cells.withColumn("_b", F.struct(F.col("cell").alias("group"), F.col(name).alias("b"))), "r", "_b")
    half = tiled_join(materialise(near, f"near-{name}"), first, "_a", "_b", "l_id", settings.tile_rows)
    return tiled_join(half, second, "_b", "l_id", "r_id", settings.tile_rows).drop("_a", "_b")


def _dense(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` without the keys under which many pairs meet, and the scored pairs of those."""
    met = rows.groupBy("key").agg(F.sum(F.col("leads").cast("bigint")).alias("_l"), F.count("*").alias("_r"))
    dense = materialise(met.select("key", (F.col("_l").cast("double") * F.col("_r")).alias("_looks")).where(
        F.col("_looks") > DENSE_PAIRS), "dense-keys")
    looks = dense.agg(F.sum("_looks")).first()[0]
    if not looks:
        return rows, None
    # Few keys are dense; Spark broadcasts the list only when its measured size allows that.
    chosen = rows.join(dense.select("key"), "key", "left_semi")
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(looks / DENSE_TASK_PAIRS))

    def side(some: DataFrame, name: str) -> DataFrame:
        wide = _side(some, name, "key")
        return wide.select("*", *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in ("n", "name", "phoneNumber", "DOB", "email")]).drop(name)

    left, right = tiles(side(chosen.where("leads"), "l"), side(chosen, "r"), "key", "l_id", "r_id", settings.tile_rows, tasks)
    tile = ("key", "_i", "_j")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from the same rows
    score = tile_scores(settings.duplicate_weights, settings.duplicate_threshold, settings.missing_dob_matches, SKETCHED, SKETCH_WORDS)
    scored = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(score, SCHEMA)
    return rows.join(dense.select("key"), "key", "left_anti"), scored


def candidate_pairs(tuples: DataFrame, bounds: Bounds, settings: Settings, dense: list[DataFrame] | None = None) -> DataFrame:
    """Pairs of tuples that may reach the threshold; none that does is missing.

    Where ``dense`` is a list, it gets the pairs under keys on which many meet, scored already, and they are left out here.
    ``_once`` says of both that a pair can meet in no other way: it is under the one key of a cell that is joined as it is.

    Cells up to ``bucket_rows`` tuples, or ARRAY_TIMES as many with ``dense``, are joined as they are.  In larger cells tuples meet on the phone with a few
    characters deleted, by classes of lengths: a pair of which one has no e-mail cannot afford more.  A pair with both e-mails and phones
    farther apart has used up so many points that its names, or its e-mails, must be similar; those are found by an index of their
    rarest letter pairs over the distinct texts of the cell.
    """
    tuples = materialise(with_sketches(tuples), "sketched")
    cells = _cells(tuples, bounds).withColumn("email_ok", F.coalesce(F.col("email") != "", F.lit(False)))
    meeting, similar = [], []
    if not bounds.needs("phoneNumber"):
        meeting.append((cells.withColumn("key", F.col("cell")), True))
    else:
        large = (
            cells.groupBy("cell")
            .agg(F.count("*").alias("_size"), F.collect_set(F.length("phoneNumber")).alias("_lengths"))
            .where(F.col("_size") > settings.bucket_rows * (1 if dense is None else ARRAY_TIMES)).drop("_size")
        )
        large = materialise(large, "large-cells")
        whole = F.concat_ws("|", F.col("cell"), F.lit("c"))
        if large.isEmpty():
            meeting.append((cells.withColumn("key", whole), True))
        else:
            # Few cells are large; Spark broadcasts the list only when its measured size allows that.
            meeting.append((cells.join(large, "cell", "left_anti").withColumn("key", whole), True))
            keys = F.explode(_phone_keys(bounds, F.col("_lengths")))
            meeting.append((cells.join(large, "cell").withColumn("key", keys).drop("_lengths"), False))
            mails = materialise(cells.where("email_ok").join(large.select("cell"), "cell", "left_semi"), "large-mails")
            least = bounds.least_text()
            if least and min(least.values()) <= 0:
                # A field that may be lost altogether forces nothing: such weights leave the cell whole.
                meeting.append((mails.withColumn("key", F.concat_ws("|", F.col("cell"), F.lit("e"))), False))
            else:
                similar = [_similar_in_cells(mails, name, bound, settings).withColumn("_once", F.lit(False)) for name, bound in least.items()]

    for rows, once in meeting:
        if dense is not None:
            rows, scored = _dense(rows, settings)
            dense += [scored.withColumn("_once", F.lit(once))] if scored is not None else []
        # Few bytes make many pairs, so the pairs and not the bytes say how many tasks share them.
        met = rows.groupBy("key").agg(F.sum(F.col("leads").cast("bigint")).alias("_l"), F.count("*").alias("_r"))
        looks = met.agg(F.coalesce(F.sum(F.col("_l").cast("double") * F.col("_r")), F.lit(0.0))).first()[0]
        tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(looks / TASK_PAIRS))
        similar.append(tiled_join(_side(rows.where("leads"), "l", "key"), _side(rows, "r", "key"), "key", "l_id", "r_id",
                                  settings.tile_rows, tasks).drop("key").withColumn("_once", F.lit(once)))
    pairs = similar[0]
    for more in similar[1:]:
        pairs = pairs.unionByName(more)
    # In a star cell a blank leads; two leads meet twice and are kept once.
    once = (F.col("l_id") < F.col("r_id")) | (F.col("l_blank") & F.col("r_filled"))
    pairs = pairs.where(once & (F.col("l_id") != F.col("r_id")))
    # Cheap upper bounds in generated code, so that few pairs reach the similarity function.
    weights = settings.duplicate_weights
    best = F.lit(100.0 * weights["DOB"])
    for name in ("name", "phoneNumber"):
        a, b = F.col(f"l_{SKETCHED[name]}_size"), F.col(f"r_{SKETCHED[name]}_size")
        best = best + weights[name] * _most_similar(name, "_")
        least = bounds.least(name)
        if least is not None:
            pairs = pairs.where(200.0 * F.least(a, b) >= (least - SLACK) * (a + b))
    best = best + F.when(F.col("l_mail") & F.col("r_mail"), weights["email"] * _most_similar("email", "_")).otherwise(0.0)
    pairs = pairs.where(best >= settings.duplicate_threshold - SLACK)
    return pairs.select("l_id", "r_id", "_once", *[
        F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in "lr" for name in ("n", "name", "phoneNumber", "DOB", "email")])


@lru_cache(maxsize=65_536)
def _sketch_bit(letter: str, time: int) -> int:
    return zlib.crc32(f"{time}{letter}".encode("utf-8", "surrogatepass")) % (64 * SKETCH_WORDS)


def _sketch(text: str | None) -> list[int] | None:
    """Bits of the letters of a text; a repeated letter has a bit for each time."""
    if text is None:
        return None
    words, seen = [0] * SKETCH_WORDS, Counter()
    for letter in text:
        bit = _sketch_bit(letter, seen[letter])
        seen[letter] += 1
        words[bit // 64] |= 1 << bit % 64
    return [word - (1 << 64) if word >> 63 else word for word in words]


def with_sketches(tuples: DataFrame) -> DataFrame:
    """``tuples`` with the lengths and letter sketches of their texts, made once per tuple and read for every pair."""

    @F.pandas_udf("array<bigint>")
    def sketch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _sketch(t) if isinstance(t, str) else None)

    made = tuples.select("*", *[sketch(name).alias(short) for name, short in SKETCHED.items()])
    parts = [F.struct(F.length(name).alias("size"), *[F.get(short, i).alias(f"w{i}") for i in range(SKETCH_WORDS)]).alias(short)
             for name, short in SKETCHED.items()]
    return made.select(*tuples.columns, *parts)


def _most_similar(name: str, joint: str = ".") -> Column:
    """Upper bound of the similarity of two texts; ``joint`` leads from a sketch to its parts.

    A bit that only one sketch has is a letter without a partner in the other text, so at least so many are not in the common
    subsequence; letters that share a bit only loosen the bound.
    """
    def part(side: str, of: str) -> Column:
        return F.col(f"{side}_{SKETCHED[name]}{joint}{of}")

    a, b = part("l", "size"), part("r", "size")

    def alone(own: str, other: str) -> Column:
        return sum(F.bit_count(part(own, word).bitwiseAND(F.bitwise_not(part(other, word)))) for word in SKETCH_PARTS[1:])

    common = F.least(a - alone("l", "r"), b - alone("r", "l"))
    return F.coalesce(F.when(a + b > 0, 200.0 * common / (a + b)), F.lit(0.0))


def score_pairs(pairs: DataFrame, settings: Settings) -> DataFrame:
    """(left, right tuple id, counts, score, signs) of the pairs at or above the threshold, as often as they meet."""
    def similar(name: str) -> Column:
        return tidy_similarity(F.col(f"l_{name}"), F.col(f"r_{name}"))  # match_rows has tidied them

    dob = equality_similarity(F.col("l_DOB"), F.col("r_DOB"))
    if settings.missing_dob_matches:
        dob = F.when(F.col("l_DOB").isNull() & F.col("r_DOB").isNull(), 100.0).otherwise(dob)
    scored = pairs.select(
        "l_id", "r_id", "l_n", "r_n", "_once",
        (F.col("l_email") == F.col("r_email")).alias("same_email"),
        similar("name").alias("name"),
        similar("phoneNumber").alias("phoneNumber"),
        dob.alias("DOB"),
        similar("email").alias("email"),
    )
    return _accepted(scored, settings)


def _accepted(scored: DataFrame, settings: Settings) -> DataFrame:
    """The score and the signs of the rows at or above the threshold; ``scored`` has ``same_email`` and the similarities of the fields."""
    parts = {name: F.col(name) for name in ("name", "phoneNumber", "DOB", "email")}
    signs = sum(F.when(shown, sign).otherwise(0) for sign, shown in (
        (SAME_EMAIL, F.col("same_email")), (NEAR_NAME, F.col("name") >= 90.0), (NEAR_PHONE, F.col("phoneNumber") >= 90.0), (SAME_DATE, F.col("DOB") >= 100.0)))
    once = ["_once"] if "_once" in scored.columns else []
    return (
        scored.withColumn("score", composite_score(parts, settings.duplicate_weights))
        .where(F.col("score") >= settings.duplicate_threshold)
        .select("l_id", "r_id", "l_n", "r_n", "score", signs.cast("tinyint").alias("signs"), *once)
    )


def duplicate_reason(signs: Column, score: Column) -> Column:
    """Comma separated signals; two missing e-mails do not count as equal."""
    names = {SAME_EMAIL: "email_match", NEAR_NAME: "name_match", NEAR_PHONE: "phone_match", SAME_DATE: "dob_match"}
    return F.concat_ws(
        ",",
        *[F.when(signs.bitwiseAND(F.lit(sign).cast("tinyint")) != 0, name) for sign, name in names.items()],
        F.concat(F.lit("score="), F.format_string("%.2f", score)),
    )


@dataclass
class FuzzyResult:
    links: DataFrame  # between tuples, the compact form: l_id, r_id, l_n, r_n, score, signs, reason
    pairs: DataFrame  # between rows, left < right


def fuzzy_pairs(df: DataFrame, settings: Settings | None = None) -> FuzzyResult:
    """Near duplicates among ``df``.

    ``links`` says everything in the least space: a link between two tuples stands for all pairs of
    their rows, a link of a tuple with itself for the pairs among its copies; its reason is a few bits until it is read.
    ``pairs`` spells the row pairs out; it is as large as the result is, and is produced in even tiles.
    """
    settings = settings or Settings()
    bounds = Bounds(settings.duplicate_weights, settings.duplicate_threshold)
    rows = match_rows(df, bounds, settings.missing_dob_matches)
    tuples = materialise(match_tuples(rows), "tuples")
    dense: list[DataFrame] = []
    between = score_pairs(candidate_pairs(tuples, bounds, settings, dense), settings)
    for scored in dense:
        between = between.unionByName(scored)
    # Most links, and there may be very many, come out once and need not travel.
    between = between.where("_once").unionByName(between.where("not _once").dropDuplicates(["l_id", "r_id"])).drop("_once")

    # Copies: every present field scores 100.
    hundred = lambda name: F.when(F.coalesce(F.col(name) != "", F.lit(False)), 100.0).otherwise(0.0)
    dob_score = F.lit(100.0) if settings.missing_dob_matches else hundred("DOB")
    copies = _accepted(tuples.where("n > 1").select(
        F.col("id").alias("l_id"), F.col("id").alias("r_id"), F.col("n").alias("l_n"), F.col("n").alias("r_n"),
        (F.col("email") != "").alias("same_email"),
        hundred("name").alias("name"), hundred("phoneNumber").alias("phoneNumber"), dob_score.alias("DOB"), hundred("email").alias("email"),
    ), settings)
    links = materialise(between.unionByName(copies), "links")
    return FuzzyResult(with_reason(links), expand_links(rows, tuples, links, settings))


def with_reason(scored: DataFrame) -> DataFrame:
    return scored.withColumn("reason", duplicate_reason(F.col("signs"), F.col("score")))


def expand_links(rows: DataFrame, tuples: DataFrame, links: DataFrame, settings: Settings) -> DataFrame:
    """Row pairs (left_id < right_id, score, signs, reason) of tuple links."""
    lone = links.where("l_n = 1 and r_n = 1").select(
        F.least("l_id", "r_id").alias("left_id"), F.greatest("l_id", "r_id").alias("right_id"), "score", "signs"
    )
    several = links.where("l_n > 1 or r_n > 1").select("l_id", "r_id", "score", "signs")
    ids = several.select(F.col("l_id").alias("id")).union(several.select("r_id")).distinct()
    wanted = tuples.join(ids, "id", "left_semi").select(
        F.struct("name", "phoneNumber", "DOB", "email", "block").alias("fields"), "id", F.col("n").alias("_n")
    )
    member = salted_join(rows, wanted, "fields", F.col("row_id")).where("id is not null")
    left = member.select(F.col("id").alias("l_id"), F.col("row_id").alias("a"))
    right = member.select(F.col("id").alias("r_id"), F.col("row_id").alias("b"))
    half = tiled_join(several, left, "l_id", "r_id", "a", settings.tile_rows)
    full = tiled_join(half, right, "r_id", "a", "b", settings.tile_rows).where(
        (F.col("l_id") != F.col("r_id")) | (F.col("a") < F.col("b"))
    )
    return with_reason(lone.unionByName(
        full.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "score", "signs")
    ))


# ---------------------------------------------------------------- the whole step


@dataclass
class DedupResult:
    survivors: DataFrame  # canonical and unduplicated rows, with the _duplicate_* columns
    review: DataFrame  # exact duplicates, and two rows for every near pair
    links: DataFrame  # near duplicates in compact form
    pairs: DataFrame  # near duplicates, numbered


META = ["_duplicate_group_id", "_duplicate_score", "_duplicate_reason"]


def find_duplicates(df: DataFrame, settings: Settings | None = None) -> DedupResult:
    """Exact duplicates leave the table, near duplicates are reported for review and stay."""
    settings = settings or Settings()
    exact = exact_email(df, settings)
    flagged = exact.flagged
    survivors = flagged.where(~F.col("_is_duplicate")).drop("_is_duplicate", "canonical_row_index")
    removed = flagged.where("_is_duplicate").select(
        *df.columns, *META, F.col("_duplicate_group_id").alias("duplicate_group_id"),
        F.col("_duplicate_reason").alias("duplicate_reason"), F.col("_duplicate_score").alias("duplicate_score"),
        "canonical_row_index",
    )
    near = fuzzy_pairs(survivors, settings)
    pairs = number_pairs(near.pairs, exact.email_groups)
    review = removed.unionByName(review_rows(survivors, pairs, settings))
    return DedupResult(survivors, review, near.links, pairs.drop("_number", "signs"))


def number_pairs(pairs: DataFrame, email_groups: DataFrame) -> DataFrame:
    """Group ids of near pairs in (left, right) order, continuing after the e-mail groups.

    The pairs of one left row are counted, and these counts put in order; a pair's number is what lies before its left row and its
    place among the pairs of that row, of which there are no more than rows.  Numbers, labels and reasons are written where they are read.
    """
    used = email_groups.agg(F.count("*")).first()[0]
    counts = pairs.groupBy("left_id").agg(F.count("*").alias("_pairs"))
    starts = running_sum(counts, [], ["left_id"], "_before", weight="_pairs")
    starts = materialise(starts.select("left_id", "_before"), "starts")
    place = F.row_number().over(Window.partitionBy("left_id").orderBy("right_id"))
    numbered = pairs.drop("reason").join(starts, "left_id").withColumn("_number", F.col("_before") + place + used).drop("_before")
    return with_reason(numbered).withColumn("group_id", group_label(F.col("_number")))


def review_rows(survivors: DataFrame, pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Both full rows of every near pair; the left one is the canonical row."""
    settings = settings or Settings()
    sides = pairs.select(
        F.inline(F.array(*[F.struct(F.col(own).alias("row_id"), F.col(other).alias("_other"))
                           for own, other in (("left_id", "right_id"), ("right_id", "left_id"))])),
        "_number", "signs",
        F.col("score").alias("duplicate_score"),
        F.col("left_id").alias("canonical_row_index"),
    )
    payload = survivors.withColumn("_own", F.col("row_id"))
    joined = tiled_join(sides, payload, "row_id", "_other", "_own", settings.tile_rows)
    return joined.select(
        *survivors.columns, group_label(F.col("_number")).alias("duplicate_group_id"),
        duplicate_reason(F.col("signs"), F.col("duplicate_score")).alias("duplicate_reason"), "duplicate_score", "canonical_row_index"
    )
