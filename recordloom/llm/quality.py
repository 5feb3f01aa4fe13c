"""Quality rules with risk-controlled thresholds.

Each rule compares one figure of a document with a cutoff.  Per stratum (language) the cutoffs are chosen together on
labelled documents: all rules are tightened step by step, at a pace that documents without a label set (at each step a rule may
reject a share of them), so that no rule holds up the others.  A step is accepted while the exact binomial bound says that the share of good documents which any rule rejects is at most ``risk``.  The sequence
stops at its first failure, so no correction is needed inside it or over rules; over strata the error level is split
evenly (Bonferroni).  With probability 1 - error no stratum loses more than its share of good documents.  A stratum
needs some 220 good labels (of four) for a first step; one with fewer gets no cutoff.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import join_figures, words_of
from recordloom.session import materialise

SYMBOLS = "[#*$%&|<>]+"
RISK = 0.02
ERROR = 0.05
WINDOW = 5
STEPS = 48


@dataclass(frozen=True)
class Rule:
    """Reject when ``figure`` is above (``high``) or below a cutoff of ``grid``, which goes from lenient to strict."""

    name: str
    figure: str
    high: bool
    grid: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", True, tuple(x / 100 for x in range(60, 1, -2))),
    Rule("dup_lines", "n_dup_lines / greatest(_lines, 1)", True, tuple(x / 100 for x in range(90, 4, -5))),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", True, tuple(x / 200 for x in range(40, 1, -2))),
    Rule("long_words", "word_chars / greatest(n_words, 1)", True, tuple(x / 2 for x in range(60, 12, -1))),
    Rule("short_words", "word_chars / greatest(n_words, 1)", False, tuple(x / 4 for x in range(6, 22))),
    Rule("few_words", "n_words", False, tuple(float(x) for x in range(10, 62, 4))),
)


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the WINDOW-word windows, in order."""
    last = F.size(words) - WINDOW
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base figures of every row; all but ``_lines`` as the contract names them.

    A null text has no words and no lines.  Rows are read one by one: repeated rows get equal figures.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col("lang").alias("_stratum"), words_of(F.col("text")).alias("_words"),
                       F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_full"),
                       F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
                       (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"))
    # Words in repeated windows: only a text with a repeat is sorted; neighbours of equal hash are repeats, and their
    # starts, in order, cover WINDOW words each less what overlaps.
    hashed = base.select("*", window_hashes(F.col("_words")).alias("_hashes"))
    again = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    items = F.when(again, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    placed = hashed.withColumn("_placed", items)
    near = F.filter("_placed", lambda p, i: F.coalesce(
        F.get("_placed", i + 1)["h"] == p["h"], F.lit(False)) | F.coalesce(
        F.when(i > 0, F.get("_placed", i - 1)["h"] == p["h"]), F.lit(False)))
    started = placed.withColumn("_starts", F.sort_array(F.transform(near, lambda p: p["i"])))
    steps = F.zip_with(F.slice("_starts", 1, F.greatest(F.size("_starts") - 1, F.lit(0))),
                       F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0))),
                       lambda a, b: F.least(b - a, F.lit(WINDOW)))
    total = F.when(F.size("_starts") > 0, F.aggregate(steps, F.lit(WINDOW), lambda done, step: done + step)).otherwise(0)
    return started.select(
        "doc_id", "_stratum", F.size("_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("n_repeat_words"), F.size("_full").alias("_lines"))


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(at most k of n) for a success probability ``share``, exact.

    The largest term is summed up as logarithms; the smaller ones follow from it by ratios.  Above the mean the
    probability is no longer small and 1 is returned, which never passes.
    """
    odds = share / (1 - share)
    top = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), n * F.log1p(F.lit(-share)),
                      lambda s, i: s + F.when(k > 0, F.log((n - i) / (i + 1) * odds)).otherwise(0.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(done: Column, i: Column) -> Column:
        j = k - i
        term = F.when(k > 0, done["term"] * (j + 1) / (n - j) / odds).otherwise(0.0)
        return F.struct(term.alias("term"), (done["sum"] + term).alias("sum"))

    below = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, down, lambda done: done["sum"])
    return F.when(k > n * share, 1.0).otherwise(F.exp(top) * below)


def level(rule: Rule) -> Column:
    """How many cutoffs of the grid a document passes, the lenient ones; it is rejected from there on."""
    figure, grid = F.expr(rule.figure), F.array(*[F.lit(x) for x in rule.grid])
    return F.size(F.filter(grid, lambda cut: figure <= cut if rule.high else figure >= cut))


def share_at(step: int) -> float:
    """What share of the documents without a label a rule may reject at a step: all at the last one."""
    return ((step + 1) / STEPS) ** 2


def even_pace(rule: Rule) -> Column:
    """The pace where all documents have labels: cutoffs used at each step, by the length of the grid."""
    return F.array(*[F.lit(int(share_at(step) * len(rule.grid))) for step in range(STEPS)])


def paces(unlabelled: DataFrame) -> DataFrame:
    """One row per stratum: of each rule, how many cutoffs of its grid are used at each step."""
    levels = [F.struct(F.lit(number).alias("rule"), level(rule).alias("level")) for number, rule in enumerate(RULES)]
    counts = unlabelled.select("_stratum", F.explode(F.array(*levels)).alias("_l")).select("_stratum", "_l.*").groupBy(
        "_stratum", "rule", "level").agg(F.count("*").alias("_n"))
    whole = counts.groupBy("_stratum", "rule").agg(
        F.sum("_n").alias("_all"), F.array_sort(F.collect_list(F.struct("level", "_n"))).alias("_at"))
    # A cutoff i rejects the documents of level i and below; used are those before the first that rejects too many.
    so_far = F.transform("_at", lambda x, i: F.struct(x["level"].alias("level"), F.aggregate(
        F.slice("_at", 1, i + 1), F.lit(0).cast("bigint"), lambda done, y: done + y["_n"]).alias("sum")))

    def used_at(step: int) -> Column:
        over = F.filter("_so_far", lambda x: x["sum"] > share_at(step) * F.col("_all"))
        return F.coalesce(F.array_min(F.transform(over, lambda x: x["level"])), F.lit(1_000))

    used = F.array(*[used_at(step) for step in range(STEPS)])
    def capped(most: int) -> Column:
        return F.transform("_used", lambda x: F.least(x, F.lit(most)))

    paced = whole.withColumn("_so_far", so_far).withColumn("_used", used)
    return paced.groupBy("_stratum").agg(*[
        F.max(F.when(F.col("rule") == number, capped(len(rule.grid)))).alias(f"_pace_{rule.name}")
        for number, rule in enumerate(RULES)])


def cutoffs(labelled: DataFrame, unlabelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum with the cutoff of each rule at the last accepted step (null: none), from good documents'
    figures."""
    pace = materialise(paces(unlabelled), "paces")
    # Written down, else each step would count the cutoffs again.
    levels = materialise(labelled.select("doc_id", "_stratum", *[level(r).alias(f"_level_{r.name}") for r in RULES]), "levels")
    paced = join_figures(levels, pace, "_stratum", F.col("doc_id"))

    def first_step(rule: Rule) -> Column:
        pace_of = F.coalesce(f"_pace_{rule.name}", even_pace(rule))
        return F.size(F.filter(pace_of, lambda used: used <= F.col(f"_level_{rule.name}")))

    steps = [first_step(rule) for rule in RULES]
    # A document is rejected from the first step of any rule on: counts per step, summed up over steps.
    firsts = paced.select("_stratum", F.least(*steps).alias("_first"))
    counts = firsts.groupBy("_stratum", "_first").agg(F.count("*").alias("_n"))
    whole = counts.groupBy("_stratum").agg(
        F.sum("_n").alias("_good"), F.map_from_entries(F.collect_list(F.struct("_first", "_n"))).alias("_at"))
    n_tests = max(1, whole.count())
    cut = whole.select("_stratum", "_good", "_at", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    rejected = F.aggregate(F.sequence(F.lit(0), F.col("step")), F.lit(0).cast("bigint"),
                           lambda s, i: s + F.coalesce(F.try_element_at("_at", i), F.lit(0).cast("bigint")))
    tested = cut.withColumn("_bad", rejected).withColumn(
        "_fails", binomial_tail(F.col("_good").cast("double"), F.col("_bad").cast("int"), risk) > error / n_tests)
    chosen = tested.groupBy("_stratum").agg(
        F.coalesce(F.min(F.when(F.col("_fails"), F.col("step"))), F.lit(STEPS)).alias("_accepted"))
    known = join_figures(chosen, pace, "_stratum", F.col("_accepted"))
    return known.select("_stratum", *[
        F.get(F.array(*[F.lit(x) for x in rule.grid]), F.get(
            F.coalesce(f"_pace_{rule.name}", even_pace(rule)), F.col("_accepted") - 1) - 1).alias(f"_cut_{rule.name}")
        for rule in RULES])


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, the base figures, base_failed and kept for every row of ``docs`` (doc_id, text, lang).

    ``labels`` (doc_id, quality) names good documents by quality 1; of repeated labels the largest counts, null ones
    and those of unknown documents don't.  A null lang is a stratum of its own.  Without labels, or with too few,
    only the base rule rejects.  Other columns are left out.
    """
    measured = materialise(figures(docs), "figures")
    good = labels.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_quality")).where("_quality = 1")
    # The base rule rejects whatever the cutoffs say, so cutoffs answer for the documents that pass it alone.
    passing = measured.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    labelled = passing.join(good, F.col("doc_id") == F.col("_labelled"), "left_semi")
    unlabelled = passing.join(
        labels.select(F.col("doc_id").alias("_labelled")), F.col("doc_id") == F.col("_labelled"), "left_anti")
    chosen = materialise(cutoffs(labelled, unlabelled, risk, error), "cutoffs")
    fires = F.lit(False)
    for rule in RULES:
        cut, figure = F.col(f"_cut_{rule.name}"), F.expr(rule.figure)
        fires = fires | F.coalesce(figure > cut if rule.high else figure < cut, F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = join_figures(measured, chosen, "_stratum", F.col("doc_id"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~fires).alias("kept"))
