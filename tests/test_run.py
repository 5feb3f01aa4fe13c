"""Running sums, outliers and the whole chain."""

import os
import random
from dataclasses import replace
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.catalog.registry import dirty
from recordloom.config import Settings
from recordloom.operators.anomaly import contamination, detect_anomalies
from recordloom.operators.cleaning import gender_from_names
from recordloom.operators.ordering import exact_percentile, running_sum
from recordloom.operators.validation import build_split
from recordloom.plans.run import read_file, run
from recordloom.session import run_scope
from recordloom.sources.sinks import read_result, write_result

S = Settings(as_of=datetime(2026, 1, 1, tzinfo=timezone.utc))
FOLDER = "/root/testdata/sf0.001"


def test_running_sum(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), i, rnd.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, w int").repartition(6)
    got = {r["i"]: r["s"] for r in running_sum(df, ["g"], ["i"], "s", weight="w").collect()}
    seen = {}
    for g, i, w in rows:
        assert got[i] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + w


def test_percentile(spark):
    values = [random.Random(4).choice([1.5, 2.0, 7.25, 9.0, 11.0]) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for share in (0.0, 0.01, 0.337, 0.5, 1.0):
        assert abs(exact_percentile(df, "v", share) - np.percentile(values, 100 * share)) < 1e-9


def test_contamination():
    assert [contamination(n) for n in (20, 100, 300, 10_000)] == [0.05, 0.03, 0.01, 0.01]


def test_outliers(spark):
    rows = [(i, 20.0 + i % 9, float(i % 50)) for i in range(398)] + [(398, 119.0, 9000.0), (399, 3.0, -7000.0)]
    df = spark.createDataFrame(rows, "row_id bigint, age double, activity_score double")
    first = detect_anomalies(df, S)
    strange = first.quarantine.orderBy("anomaly_score").collect()
    assert {398, 399} <= {r["row_id"] for r in strange[:2]} and len(strange) <= 4
    assert first.stable.count() + len(strange) == 400
    again = detect_anomalies(df.repartition(5), S).quarantine.collect()
    assert sorted(r["row_id"] for r in again) == sorted(r["row_id"] for r in strange)
    assert detect_anomalies(df.limit(10), S).quarantine.count() == 0


def test_whole_chain_loses_no_row(spark):
    people = dirty(spark, FOLDER)
    result = run(people, S)
    counts = result.counts.first()
    exact = result.duplicates.where("duplicate_reason = 'exact_email_match'").count()
    assert counts["input_rows"] == people.count() == counts["clean_rows"] + counts["quarantined_rows"] + exact
    assert counts["duplicate_rows"] == result.duplicates.count()
    names = result.clean.select("username").collect()
    assert len({r["username"] for r in names}) == len(names)
    text = result.summary.first()["summary"]
    assert "Input rows: 150" in text and "- prenom -> name (99.0%, name_header_heuristic)" in text


def test_csv_file_to_clean_records(spark, tmp_path):
    (tmp_path / "p.csv").write_text("First Name,surname,E-Mail,extra\nAli,Ben,ali@x.dz,1\nSara,K,SARA@gmial.com,2\n")
    rows = read_file(spark, str(tmp_path / "p.csv"))
    assert [r["row_id"] for r in rows.orderBy("row_id").collect()] == [0, 1]
    clean = run(rows, replace(S, email_domain="x.org")).clean.orderBy("name").collect()
    assert [(r["name"], r["email"], r["username"]) for r in clean] == [("Ali Ben", "ali@x.dz", "ali_ben"), ("Sara K", "sara@gmail.com", "sara_k")]


def test_near_duplicates_never_meet_in_a_nested_loop(spark):
    from recordloom.operators.dedup import Bounds, candidate_pairs, match_rows, match_tuples

    people = spark.range(50).select(
        F.col("id").alias("row_id"), F.lit("Ali Ben").alias("name"), F.lit("+213550000000").alias("phoneNumber"),
        F.lit(5).cast("bigint").alias("DOB"), F.lit(None).cast("string").alias("email"), F.lit("Oran").alias("wilaya"))
    bounds = Bounds(S.duplicate_weights, S.duplicate_threshold)
    plan = candidate_pairs(match_tuples(match_rows(people, bounds)), bounds, S)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_result_is_published_whole_or_not_at_all(spark, tmp_path):
    people = dirty(spark, FOLDER).limit(30)
    forms = {form: str(tmp_path / form) for form in ("parquet", "csv", "json")}
    with run_scope(spark) as scope:
        result = run(people, replace(S, forest_trees=0))
        counts = result.counts.first()
        lost = replace(result, summary=result.summary.select(F.raise_error(F.lit("lost")).alias("summary")))
        with pytest.raises(Exception, match="lost"):
            write_result(lost, forms["parquet"])
        with pytest.raises(Exception):
            read_result(spark, forms["parquet"])
        for form, path in forms.items():
            write_result(result, path, form)
    for path in forms.values():
        tables = read_result(spark, path)
        assert tables["clean"].count() == counts["clean_rows"] and tables["duplicates"].count() == counts["duplicate_rows"]
        assert "Clean records: " + str(counts["clean_rows"]) in tables["summary"].first()[0]
    # The run's own tables are gone.
    assert sum(len(files) for _, _, files in os.walk(scope)) <= 4 and spark.conf.get("recordloom.run.dir", None) is None


def test_gender_by_first_name_spreads_a_hot_name(spark):
    rows = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Amina").when(F.col("id") % 3 == 1, "Karim").alias("name"),
                                   F.when(F.col("id") % 10 == 0, "male").alias("gender"))
    names = spark.createDataFrame([("AMINA", "mostly_female"), ("karim", "male"), ("amina", "female")], "first_name string, gender string")
    found = gender_from_names(rows, names, "name", "gender")
    assert found.columns == rows.columns
    for r in found.collect():
        assert r.gender == ("male" if r.row_id % 10 == 0 else ("female", "male", None)[r.row_id % 3])


def test_columns_of_any_name_survive_validation(spark):
    rows = spark.createDataFrame([(1, "Ali Ben", "mine", "other", "kept", 5)], "row_id int, name string, _name string, _email string, _lacking string, __kind int")
    rejected = build_split(rows, S).rejected
    assert rejected.columns == [*rows.columns, "failure_reason", "row_index"]
    assert rejected.select(*rows.columns).collect() == rows.collect()
