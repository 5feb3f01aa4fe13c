"""Toxicity by a classifier chain.

Categories are predicted one after the other; the model of a later one also sees the probabilities of the earlier
ones.  While training these are out-of-fold: each document's comes from models that were fitted without it.  Models
are logistic regressions over which words and word beginnings occur in a text, restricted to the ones that labels
speak about.  They are fitted in parallel, one group per fold, on at most ``sample`` labelled documents; everything
is then scored with the models fitted on all folds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import kept_as_table, small_batches, split_by_keys
from recordloom.session import materialise

WORDS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (3, 4, 5, 6, 7)
CACHED = 300_000
# Documents whose features are laid out at once when they are counted.
TOGETHER = 256
# A threshold that no probability reaches.
NEVER = 2.0


@dataclass(frozen=True)
class Chain:
    """``categories`` in their order, each a label column and the value that means yes; the last one decides.

    At most ``sample`` labelled documents, those of smallest hash, are fitted on, ``features`` features a model.
    """

    categories: tuple[tuple[str, str, int], ...] = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
    sample: int = 8_000
    folds: int = 5
    features: int = 2_000
    least_support: int = 3
    least_z: float = 3.0
    penalty: float = 1e-3
    steps: int = 300


def feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) >> 33


def features_of(word: str) -> set[int]:
    return {feature(word), *(feature(f"{word[:n]}*") for n in BEGINNINGS if len(word) > n)}


def document_features(texts: DataFrame) -> DataFrame:
    """(_key, feats): the hashed features that occur in each text, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set().union(*map(features_of, set(WORDS((text.as_py() or "").lower())))))
                     for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found, pa.list_(pa.int32()))], ["_key", "feats"])

    small_batches(texts.sparkSession)
    return texts.select("_key", "text").mapInArrow(run, "_key bigint, feats array<int>")


def counted(feats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of some documents, sorted, and in how many each occurs; a few documents are laid out at a time."""
    ids, counts = np.empty(0, np.int32), np.empty(0, np.int64)
    for at in range(0, len(feats), TOGETHER):
        more, n = np.unique(np.concatenate(feats[at: at + TOGETHER]), return_counts=True)
        both, place = np.unique(np.concatenate([ids, more]), return_inverse=True)
        summed = np.zeros(len(both), np.int64)
        summed[place[: len(ids)]] = counts
        summed[place[len(ids):]] += n
        ids, counts = both, summed
    return ids, counts


def located(feats: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the features ``ids`` (sorted) occur: numbers of documents and, beside them, places in ``ids``."""
    of, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for number, found in enumerate(feats if len(ids) else []):
        place = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
        place = place[ids[place] == found]
        of.append(np.full(len(place), number))
        at.append(place)
    return np.concatenate(of), np.concatenate(at)


def fit(rows: pd.DataFrame, how: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Features, their weights, the weights of earlier probabilities, and the bias, from feats, earlier and y.

    Only the chosen features are ever laid out for all documents.
    """
    y = rows["y"].to_numpy(float)
    earlier = np.array(rows["earlier"].tolist(), float).reshape(len(rows), -1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    feats = [np.asarray(found, np.int32) for found in rows["feats"]]
    if not len(y) or y.min() == y.max() or not any(map(len, feats)):
        return np.empty(0, np.int32), np.empty(0), np.zeros(earlier.shape[1]), bias
    ids, total = counted(feats)
    present, n = counted([found for found, is_yes in zip(feats, y) if is_yes])
    yes = np.zeros(len(ids))
    yes[np.searchsorted(ids, present)] = n
    p, q = (yes + 0.5) / (y.sum() + 1), (total - yes + 0.5) / (len(y) - y.sum() + 1)
    z = np.log(p / q) / np.sqrt(1 / (yes + 0.5) + 1 / (total - yes + 0.5))
    good = np.flatnonzero((total >= how.least_support) & (np.abs(z) >= how.least_z))
    good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[: how.features]])
    of, at = located(feats, ids[good])
    weights, chained = np.zeros(len(good)), np.zeros(earlier.shape[1])
    # Gradient steps with momentum; the step size follows from the densest document.
    rate = 4.0 / (1 + np.bincount(of, minlength=len(y)).mean() + earlier.shape[1])
    speed = [np.zeros_like(weights), np.zeros_like(chained), 0.0]
    for _ in range(how.steps):
        margin = bias + np.bincount(of, weights[at], len(y)) + earlier @ chained
        wrong = (y - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) / len(y)
        slopes = (np.bincount(at, wrong[of], len(good)) - how.penalty / 10 * weights, earlier.T @ wrong - how.penalty * chained,
                  float(wrong.sum()))
        speed = [0.9 * s + rate * g for s, g in zip(speed, slopes)]
        weights, chained, bias = weights + speed[0], chained + speed[1], bias + speed[2]
    return ids[good], weights, chained, bias


def fitted(sample: DataFrame, how: Chain) -> dict[int, dict]:
    """A model per fold, fitted on all other folds, and under ``how.folds`` one on everything: few small rows."""
    others = F.filter(F.sequence(F.lit(0), F.lit(how.folds)), lambda f: f != F.col("fold"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        feats, weights, chained, bias = fit(rows.sort_values("_key"), how)
        return pd.DataFrame([{"group": rows["group"].iloc[0], "feats": feats, "weights": weights, "chained": chained, "bias": bias}])

    models = sample.withColumn("group", F.explode(others)).groupBy("group").applyInPandas(
        run, "group int, feats array<int>, weights array<double>, chained array<double>, bias double")
    return {row["group"]: row.asDict() for row in models.collect()}


def chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def base_rate(sample: DataFrame, number: int) -> dict:
    """The model of a group without documents to learn from: the share of yes in the sample, and nothing of the text."""
    n, yes = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    return {"feats": [], "weights": [], "chained": [0.0] * number, "bias": float(np.log((yes + 0.5) / (n - yes + 0.5))) if yes else -30.0}


def out_of_fold(sample: DataFrame, models: dict[int, dict]) -> DataFrame:
    """Append to ``earlier`` the probability by the model that never saw the document."""
    tables = {g: dict(zip(m["feats"], m["weights"])) for g, m in models.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            margins = [
                models[f]["bias"] + sum(tables[f].get(x, 0.0) for x in feats) + float(np.dot(models[f]["chained"], earlier))
                for f, feats, earlier in zip(rows["fold"], rows["feats"], rows["earlier"])]
            rows["earlier"] = [[*earlier, chance(m)] for earlier, m in zip(rows["earlier"], margins)]
            yield rows

    return sample.mapInPandas(run, sample.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, how: Chain) -> DataFrame:
    """(_key, fold, feats, targets) of the sample; only texts that may be in it travel."""
    given = F.array(*[F.col(column) for _, column, _ in how.categories])
    marks = labels.select(F.col("doc_id").alias("_key"), *[
        F.when(F.col(column).isNotNull(), (F.col(column) == yes).cast("int")).alias(name)
        for name, column, yes in how.categories], given.alias("_given"))
    marks = marks.where(F.col("_key").isNotNull() & F.forall("_given", lambda v: v.isNotNull())).groupBy("_key").agg(
        F.array(*[F.max(name) for name, *_ in how.categories]).alias("targets"))
    chosen = materialise(marks.orderBy(F.xxhash64(F.lit(17), "_key"), "_key").limit(how.sample), "sample")
    near, _ = split_by_keys(docs.select(F.col("doc_id").alias("_key"), "text").where("_key is not null"), chosen, "_key")
    texts = near.join(chosen.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(19), "_key"), F.lit(how.folds)).cast("int")
    return kept_as_table(document_features(texts).join(chosen, "_key").withColumn("fold", fold), "labelled")


def best_threshold(sample: DataFrame) -> float:
    """The out-of-fold probability that splits the decisive category with the best F1.

    It lies above the base rate.  Where no split does better than to flag everything, the sample holds no signal, and
    nothing reaches the threshold.
    """
    judged = sample.select(F.round(F.element_at("earlier", -1), 2).alias("p"), "y").groupBy("p").agg(
        F.sum("y").alias("yes"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()  # at most 101 rows
    total, size, hits, flagged = sum(r["yes"] for r in judged), sum(r["n"] for r in judged), 0, 0
    if not total:
        return NEVER
    rate = total / size
    best = (2 * total / (total + size), NEVER)
    for row, after in zip(judged, [*judged[1:], None]):
        hits, flagged = hits + row["yes"], flagged + row["n"]
        score, cut = 2 * hits / (total + flagged), (row["p"] + (after["p"] if after else 0.0)) / 2
        if score > best[0] and cut > rate:
            best = (score, cut)
    return float(best[1] if best[1] == NEVER else min(max(best[1], 0.05), 0.95))


@dataclass(frozen=True)
class Fitted:
    """What scoring needs: per category its features with weights, weights of earlier categories, and bias."""

    names: tuple[str, ...]
    models: tuple[dict, ...]
    threshold: float


def fit_chain(docs: DataFrame, labels: DataFrame, how: Chain = Chain()) -> Fitted:
    sample = labelled_sample(docs, labels, how)
    rows = sample.withColumn("earlier", F.array().cast("array<double>"))
    models = []
    for number in range(len(how.categories)):
        rows = rows.withColumn("y", F.get("targets", number))
        nothing = base_rate(rows, number)
        fits = {group: nothing for group in range(how.folds + 1)} | fitted(rows, how)
        models.append(fits[how.folds])
        rows = materialise(out_of_fold(rows, fits), "out-of-fold")
    chain = Fitted(tuple(name for name, *_ in how.categories), tuple(models), best_threshold(rows))
    # A document that says nothing is not toxic, whatever the base rate.
    return replace(chain, threshold=max(chain.threshold, Scorer(chain).scores("")[-1] + 0.01))


class Scorer:
    """Probabilities of a text, word by word through a bounded cache."""

    def __init__(self, chain: Fitted):
        self.chain, self.known = chain, {}
        self.tables = [dict(zip(m["feats"], m["weights"])) for m in chain.models]
        self.used = set().union(*self.tables)

    def scores(self, text: str | None) -> list[float]:
        words = set(WORDS((text or "").lower()))
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        for word in words.difference(known):
            known[word] = tuple(features_of(word) & self.used)
        present = set().union(*filter(None, map(known.__getitem__, words)))
        earlier: list[float] = []
        for model, table in zip(self.chain.models, self.tables):
            margin = model["bias"] + sum(table.get(x, 0.0) for x in sorted(present)) + float(np.dot(model["chained"], earlier))
            earlier.append(chance(margin))
        return earlier


def scored(texts: DataFrame, chain: Fitted) -> DataFrame:
    """``texts`` (text and any other columns) with ``_scores``, an array of the categories' probabilities."""
    shared = texts.sparkSession.sparkContext.broadcast(chain)  # at most categories * features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = pa.array([scorer.scores(text.as_py()) for text in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "_scores"])

    small_batches(texts.sparkSession)
    return texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, _scores array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, how: Chain = Chain()) -> DataFrame:
    """doc_id, the probability of each category, and ``toxic``, per row of ``docs`` (doc_id, text).

    ``toxic`` holds where the last category's probability reaches the threshold with the best F1 out of fold.  A
    null or empty text has no features and gets the models' base rates.  Labels with a null or of unknown documents
    don't count, of repeated ones the largest does.  Without a labelled yes, or a split of the labels that beats flagging
    all, nothing is toxic.  Repeated rows get equal
    answers; other columns are left out.
    """
    chain = fit_chain(docs, labels, how)
    names = [F.get("_scores", i).alias(f"p_{name}") for i, name in enumerate(chain.names)]
    return scored(docs, chain).select(
        "doc_id", *names, (F.get("_scores", len(chain.names) - 1) >= chain.threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, how: Chain = Chain()) -> DataFrame:
    """``docs`` (all its columns) without the rows that ``toxicity`` rejects; rows are judged where they are read."""
    chain = fit_chain(docs, labels, how)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            clean = [scorer.scores(text.as_py())[-1] < chain.threshold for text in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
