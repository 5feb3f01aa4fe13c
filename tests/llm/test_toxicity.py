import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordloom.llm.toxicity import WORDS, Chain, drop_toxic, features_of, fit, fit_chain, toxicity


def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the labels, judged on the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity(docs, marks.where("doc_id % 3 > 0"))
    held = found.join(marks.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id")
    n = {(r.truth, r.toxic): r["count"] for r in held.groupBy("truth", "toxic").count().collect()}
    hit, missed, wrong = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.97


def test_rejected_documents_go_and_columns_stay(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    toxic = {r.doc_id for r in toxicity(docs, labels(spark)).where("toxic").collect()}
    left = drop_toxic(docs, labels(spark))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in toxic)
    assert drop_toxic(odd, labels(spark)).columns == odd.columns


def test_later_models_see_earlier_probabilities_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = (sorted(map(tuple, toxicity(docs.repartition(n), labels(spark)).collect())) for n in (1, 4))
    assert [(i, round(p, 9), round(q, 9), t) for i, p, q, t in one] == [(i, round(p, 9), round(q, 9), t) for i, p, q, t in two]


def test_odd_rows_missing_labels_and_an_empty_table(spark, odd, empty):
    assert toxicity(odd, labels(spark)).count() == odd.count()
    assert not toxicity(odd, labels(spark).where("false")).where("toxic").collect()
    mixed = labels(spark).limit(3).union(spark.createDataFrame([(None, 1, 1), (4, None, 1), (5, 1, None), (7, 0, 1)], "doc_id bigint, quality int, toxic int"))
    assert toxicity(odd, mixed, Chain(sample=5)).count() == odd.count()
    assert toxicity(empty, labels(spark)).collect() == []
    assert toxicity(odd, labels(spark).where("toxic = 0")).where(F.col("toxic")).collect() == []


@pytest.mark.parametrize("marks", [[(1, 1)], [(0, 1), (1, 0)], [(3, 1)], [(i, i % 2) for i in range(8)], [(i, int(i == 3)) for i in range(20)],
                                   [(i, 1) for i in range(20)]])
def test_few_labels_or_no_signal_reject_nothing(spark, marks):
    """All labels in one fold, and labels that no word goes with."""
    texts = [f"{a} {b} word{i}" for i, (a, b) in enumerate([("some", "plain"), ("other", "text")] * 10)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    given = spark.createDataFrame([(i, 1 - t, t) for i, t in marks], "doc_id bigint, quality int, toxic int")
    assert drop_toxic(docs, given).count() == len(texts)


def test_chained_weights_and_probabilities_equal_a_plain_chain(spark):
    """The second model weighs the first one's probability, and scores are those of a chain in plain numpy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    chain = fit_chain(docs, labels(spark))
    assert len(chain.models[1]["chained"]) == 1 and abs(chain.models[1]["chained"][0]) > 0.01
    for row in toxicity(docs, labels(spark)).join(docs, "doc_id").limit(40).collect():
        present, earlier = set().union(*map(features_of, WORDS((row.text or "").lower()))), []
        for model in chain.models:
            margin = model["bias"] + sum(w for f, w in zip(model["feats"], model["weights"]) if f in present) + np.dot(model["chained"], earlier)
            earlier.append(1 / (1 + np.exp(-margin)))
        assert [row.p_low_quality, row.p_toxic] == pytest.approx(earlier, abs=1e-9)


def test_a_model_is_fitted_without_laying_out_all_features():
    rng = np.random.default_rng(3)
    feats = [np.unique(rng.integers(0, 100_000, 1_500)).astype(np.int32) for _ in range(2_000)]
    y = rng.integers(0, 2, len(feats))
    feats = [np.union1d(f, [200_000 + label]).astype(np.int32) for f, label in zip(feats, y)]
    rows = pd.DataFrame({"feats": feats, "earlier": [[]] * len(feats), "y": y})
    tracemalloc.start()
    ids, weights, _, _ = fit(rows, Chain())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {200_000, 200_001} <= set(ids.tolist()) and weights[ids == 200_001] > 0 > weights[ids == 200_000]
    assert peak < 16 * sum(map(len, feats))
