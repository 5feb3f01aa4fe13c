"""Mixing sources to target weights.

Word counts are summed per source, targets follow from weights, and each source gets a repetition rate.  A document
is emitted floor(rate) times, plus once more with probability equal to the fraction; the draw is a seeded hash of
the document, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import join_figures, n_words, row_key
from recordloom.operators.ordering import dense_index
from recordloom.session import materialise

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn.  Together the targets are the sum of all
    sizes.  A target stops at ``most`` times its source's size and the excess goes to the others by weight, again
    and again until no target is above; that fixed point is one level times weight for all that are not stopped.
    A source without words has target and rate 0.
    """
    totals = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("source_size"))
    ranked = dense_index(totals.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    plan = materialise(ranked.select("source", "source_size", turn.alias("_weight"),
                                     (F.col("source_size") * most).alias("_stop")), "sources")
    everything, weight = plan.agg(F.sum("source_size"), F.sum("_weight")).first()
    everything, level, stopped = everything or 0, 0.0, -1
    if everything:
        level = everything / weight
        while True:
            above = F.col("_stop") <= F.col("_weight") * level
            count, words, shares = plan.where(above).agg(F.count("*"), F.sum("_stop"), F.sum("_weight")).first()
            if count == stopped or not count or shares == weight:
                break
            stopped, level = count, (everything - words) / (weight - shares)
    target = F.least(F.col("_stop").cast("double"), F.col("_weight") * level)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return plan.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies() -> Column:
    chance = F.pmod(F.col("_draw"), F.lit(1 << 53)) / float(1 << 53)
    return (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def mix_digest(docs: DataFrame, seed: int = 20240301) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for every row of ``docs``.

    Null and blank texts have size 0 and take nothing.  A null source is a source of its own.  Repeated rows get
    the same number of copies each.
    """
    sized = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                    row_key(seed, "doc_id", "text").alias("_draw")), "sized")
    return join_figures(sized, source_rates(sized), "source", F.col("_draw")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("bigint").alias("taken"))


def mix(docs: DataFrame, seed: int = 20240301) -> DataFrame:
    """``docs`` with each row repeated as its source's rate says, all columns unchanged; see ``mix_digest``."""
    rates = source_rates(docs.select("source", n_words(F.col("text")).alias("size")))
    rows = docs.select(F.struct("*").alias("_row"), "source", row_key(seed, "doc_id", "text").alias("_draw"))
    return join_figures(rows, rates, "source", F.col("_draw")).select(
        "_row", F.explode(F.array_repeat(F.lit(0), copies()))).select("_row.*")
