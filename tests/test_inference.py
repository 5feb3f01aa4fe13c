"""Unique names against the sequential rule, and the order of inference."""

import random
from datetime import datetime, timezone

from recordloom.config import Settings
from recordloom.operators.inference import assign_unique, infer_table

SETTINGS = Settings(as_of=datetime(2026, 1, 1, tzinfo=timezone.utc))


def one_by_one(asks, taken, separator):
    used, given = set(taken), {}
    for row, name in sorted(asks):
        chosen, i = name, 1
        while chosen in used:
            chosen = f"{name}{separator}{i:02d}"
            i += 1
        used.add(chosen)
        given[row] = chosen
    return given


def test_unique_names_equal_the_sequential_rule(spark):
    rnd = random.Random(1)
    for separator, stems in (("_", ["ali", "ali_01", "ali_01_01", "ali_02", "ali_03", "sara"]), (".", ["a.0001", "a.0001.01", "b.0002"])):
        asks = [(i, rnd.choice(stems)) for i in rnd.sample(range(500), 60)]
        taken = [s + rnd.choice(["", f"{separator}0{rnd.randrange(1, 9)}", f"{separator}001", f"{separator}1"]) for s in rnd.choices(stems, k=5)]
        given = assign_unique(
            spark.createDataFrame(asks, "row_id bigint, candidate string"),
            spark.createDataFrame([(t,) for t in taken], "name string"), separator,
        ).collect()
        assert {r["row_id"]: r["given"] for r in given} == one_by_one(asks, taken, separator)


def test_many_rows_of_one_name_pass_one_hundred(spark):
    asks = [(i, "user") for i in range(130)]
    given = assign_unique(
        spark.createDataFrame(asks, "row_id bigint, candidate string"),
        spark.createDataFrame([("user_100",), ("user_05",)], "name string"), "_",
    ).collect()
    assert {r["row_id"]: r["given"] for r in given} == one_by_one(asks, ["user_100", "user_05"], "_")


def test_goldens(spark):
    rows = [
        (7, "Ali Ben", None, None, None, "20.9"),
        (8, "Ali Ben", None, None, "x@y.dz", "2"),
        (9, "Ali X Ben", None, None, "a@y.dz", "abc"),
        (12, "أحمد", None, None, "b@y.dz", None),
        (13, None, None, None, "ali_b.12@x.y", None),
        (14, "Sam", "Kept", "kept_name", "k@y.dz", None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, name string, last string, username string, email string, age string")
    got = {r["row_id"]: r for r in infer_table(df, SETTINGS).collect()}
    assert [got[i]["username"] for i in (7, 8, 9, 12, 14)] == ["ali_ben", "ali_ben_01", "ali_ben_02", "user_0012", "kept_name"]
    assert got[7]["email"] == "ali.ben.0007@gmail.com"
    assert got[13]["name"] == "ali b" and got[13]["last"] == "b"
    assert got[7]["DOB"] == 1136073600 and got[8]["DOB"] is None and got[9]["DOB"] is None
    assert got[12]["last"] == "أحمد" and got[14]["last"] == "Kept" and got[14]["name"] == "Sam"
    assert got[7]["gender"] == "male" and got[7]["userType"] == "student"
