"""Near and exact duplicates against a brute-force reading of the rules."""

import random
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from recordloom.config import Settings
from recordloom.operators import dedup
from recordloom.operators.dedup import exact_email, find_duplicates, fuzzy_pairs

SETTINGS = Settings(as_of=datetime(2026, 1, 1, tzinfo=timezone.utc))
SCHEMA = "row_id bigint, name string, phoneNumber string, DOB bigint, email string, wilaya string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(new[-1], row[j], row[j - 1] + (x == y)))
        row = new
    return row[-1]


def similar(a, b):
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if not a or not b:
        return 0.0
    return 100.0 if a == b else 100.0 * (1 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b)))


def total(l, r, w):
    dob = 100.0 if l[3] is not None and l[3] == r[3] else 0.0
    return (similar(l[1], r[1]) * w["name"] + similar(l[2], r[2]) * w["phoneNumber"]
            + dob * w["DOB"] + similar(l[4], r[4]) * w["email"])


def brute_force(rows, settings):
    found = {}
    for i, l in enumerate(rows):
        for r in rows[i + 1:]:
            lb, rb = (l[5] or "").lower()[:8], (r[5] or "").lower()[:8]
            if lb and rb and lb != rb:
                continue
            score = total(l, r, settings.duplicate_weights)
            if score >= settings.duplicate_threshold:
                found[(l[0], r[0])] = score
    return found


def people(seed, n, hot=False):
    rnd = random.Random(seed)
    firsts, lasts = ["Amine", "Amina", "Karim", "Sara", "Salim"], ["Benali", "Bensaid", "Hamou", "Ben Ali"]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            _, name, phone, dob, mail, wilaya = rnd.choice(rows)
            if rnd.random() < 0.5:
                k = rnd.randrange(len(name))
                name = name[:k] + rnd.choice("aeinlx") + name[k + rnd.randrange(2):]
            if rnd.random() < 0.5:
                k = rnd.randrange(4, len(phone))
                phone = phone[:k] + rnd.choice("0123456789") + phone[k + 1:]
            if rnd.random() < 0.2:
                phone = phone[:6] + phone[7:]
            if rnd.random() < 0.3:
                mail = rnd.choice([None, "a.b@gmail.com", "a.b2@gmail.com"])
            if rnd.random() < 0.2:
                wilaya = rnd.choice([None, "", "Oran", "Alger"])
        else:
            name = f"{rnd.choice(firsts)} {rnd.choice(lasts)}"
            phone = "+2135" + "".join(rnd.choice("05") for _ in range(8))
            dob = 0 if hot else rnd.choice([None, 0, 86400, 31536000])
            mail = rnd.choice([None, "x.y@gmail.com", f"u{i % 7}@yahoo.com", "a.b@gmail.com"])
            wilaya = rnd.choice([None, "Oran", "Alger", "Oran"])
        rows.append((i, name, phone, dob, mail, wilaya))
    return rows


def check(spark, rows, settings):
    df = spark.createDataFrame(rows, SCHEMA)
    got = fuzzy_pairs(df, settings).pairs.collect()
    pairs = {(r["left_id"], r["right_id"]): r["score"] for r in got}
    assert len(got) == len(pairs), "a pair came out twice"
    want = brute_force(rows, settings)
    assert set(pairs) == set(want)
    assert all(abs(pairs[k] - want[k]) < 1e-9 for k in want)
    return want


@pytest.mark.parametrize("bucket,tile", [(20_000, 4_096), (4, 3)])
@pytest.mark.parametrize("hot", [False, True])
def test_pairs_equal_brute_force(spark, bucket, tile, hot):
    want = check(spark, people(7, 110, hot), replace(SETTINGS, bucket_rows=bucket, tile_rows=tile))
    assert want


@pytest.mark.parametrize("weights,threshold", [
    ({"name": 0.5, "phoneNumber": 0.2, "DOB": 0.2, "email": 0.1}, 75.0),
    ({"name": 0.25, "phoneNumber": 0.25, "DOB": 0.25, "email": 0.25}, 70.0),
    ({"name": 0.3, "phoneNumber": 0.3, "DOB": 0.1, "email": 0.3}, 92.0),
])
def test_other_weights(spark, weights, threshold):
    check(spark, people(3, 80), replace(SETTINGS, duplicate_weights=weights, duplicate_threshold=threshold,
                                        bucket_rows=4, tile_rows=5))


def test_exact_email(spark):
    rows = [
        (1, "Ali Ben", "+213550000001", 10, "b@x.dz", None),
        (2, "Zed Zed", "+213550000001", 20, "b@x.dz", None),
        (3, "Yyy Qqq", "+213660000009", 30, "b@x.dz", None),
        (4, "One Two", "+213550000004", 40, "a@x.dz", None),
        (5, "Xyz Uvw", "+213770000005", 50, "a@x.dz", None),
        (6, "No Mail", None, None, None, None),
        (7, "No Mail", None, None, "", None),
    ]
    result = exact_email(spark.createDataFrame(rows, SCHEMA), SETTINGS).flagged
    got = {r["row_id"]: r for r in result.collect()}
    assert [i for i, r in got.items() if r["_is_duplicate"]] == [2]
    assert got[2]["canonical_row_index"] == 1
    # The unconfirmed e-mail used up number 1.
    assert got[1]["_duplicate_group_id"] == got[2]["_duplicate_group_id"] == "dup_000002"
    assert got[4]["_duplicate_group_id"] == got[3]["_duplicate_group_id"] == ""
    assert got[2]["_duplicate_score"] == 100.0


def test_review_rows_and_numbers(spark):
    rows = people(11, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    result = find_duplicates(df, replace(SETTINGS, bucket_rows=5, tile_rows=4))
    survivors = result.survivors.count()
    pairs = [r.asDict() for r in result.pairs.orderBy("left_id", "right_id").collect()]
    removed = len(rows) - survivors
    assert result.review.count() == removed + 2 * len(pairs)
    numbers = [int(p["group_id"][4:]) for p in pairs]
    assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    mails = {}
    for r in rows:
        if r[4]:
            mails[r[4]] = mails.get(r[4], 0) + 1
    assert numbers[0] == 1 + sum(1 for n in mails.values() if n > 1)


def test_copies_link_once(spark):
    rows = [(i, "Amine Benali", "+213550000000", 5, None, "Oran") for i in range(30)]
    result = fuzzy_pairs(spark.createDataFrame(rows, SCHEMA), replace(SETTINGS, tile_rows=4))
    assert result.links.count() == 1
    assert result.pairs.count() == 30 * 29 // 2


def test_results_do_not_depend_on_partitions(spark):
    rows = people(5, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    one = find_duplicates(df.coalesce(1), SETTINGS).pairs.select("left_id", "right_id", "group_id").collect()
    many = find_duplicates(df.orderBy(F.rand(3)).repartition(7), SETTINGS).pairs.select(
        "left_id", "right_id", "group_id").collect()
    assert sorted(one) == sorted(many)


def test_missing_dates_match_on_request(spark):
    rows = [(0, "Amine Benali", "+213550000000", None, None, None),
            (1, "Amine Benaly", "+213550000000", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert fuzzy_pairs(df, SETTINGS).pairs.count() == 0
    assert fuzzy_pairs(df, replace(SETTINGS, missing_dob_matches=True)).pairs.count() == 1


def test_one_odd_phone_leaves_the_rest_of_its_cell_on_phone_keys(spark):
    """400 people born on one day without e-mails, and phones of 12 to 18 digits now and then."""
    rnd = random.Random(5)
    rows = [(i, f"Amine Benali {chr(97 + i % 5)}", f"+2135{rnd.randrange(10**8):08d}", 378691200, None, "Oran") for i in range(400)]
    for i in range(40, 80):  # a digit or two changed, dropped or added
        phone = list(rows[i - 40][2])
        for _ in range(rnd.randrange(1, 3)):
            at = rnd.randrange(5, len(phone))
            phone[at:at + rnd.randrange(0, 2)] = [str(rnd.randrange(10))] * rnd.randrange(0, 2)
        rows[i] = (i, rows[i - 40][1], "".join(phone), *rows[i][3:])
    rows.append((400, "Amine Benali a", rows[0][2] + "123", 378691200, None, "Oran"))
    rows.append((401, "Amine Benali b", rows[1][2] + "1234567", 378691200, None, "Oran"))
    rows.append((402, "Amine Benali b", rows[1][2] + "1234568", 378691200, None, "Oran"))
    settings = replace(SETTINGS, bucket_rows=50, tile_rows=16)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["left_id"], r["right_id"]): r["score"] for r in fuzzy_pairs(df, settings).pairs.collect()}
    assert found == pytest.approx(brute_force(rows, settings))
    bounds = dedup.Bounds(settings.duplicate_weights, settings.duplicate_threshold)
    tuples = dedup.match_tuples(dedup.match_rows(df, bounds))
    # All pairs of the cell would be 80,000, once for its own block and once for blank ones.
    assert dedup.candidate_pairs(tuples, bounds, settings).count() < 4_000


def test_blocks_follow_the_kind_of_location(spark):
    """Text locations are blocks of their own, blank ones meet every block, structures share one."""
    rows = [("Oran", "x"), (None, "Some place"), (None, " some PLACE "), (None, ""), (None, "nan"), (None, None)]
    df = spark.createDataFrame([(i, "A B", "+213550000000", 1, None, w, t) for i, (w, t) in enumerate(rows)],
                               SCHEMA + ", location string")
    bounds = dedup.Bounds(SETTINGS.duplicate_weights, SETTINGS.duplicate_threshold)
    blocks = {r["row_id"]: r["fields"]["block"] for r in dedup.match_rows(df, bounds).collect()}
    assert blocks == {0: "oran", 1: "some place", 2: "some place", 3: "", 4: "", 5: ""}
    nested = df.withColumn("location", F.when(F.col("row_id") < 3, F.struct(F.col("location").alias("fullLocation"))))
    blocks = {r["row_id"]: r["fields"]["block"] for r in dedup.match_rows(nested, bounds).collect()}
    assert blocks == {0: "oran", 1: dedup.NO_PROVINCE, 2: dedup.NO_PROVINCE, 3: "", 4: "", 5: ""}


def test_letter_sketches_bound_the_similarity_from_above(spark):
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice("aab0129é@.") for _ in range(draw.randint(1, 24))) for _ in range(60)] + ["aaaa", "a"]
    rows = [(i, a, a, a) for i, a in enumerate(texts)]
    made = dedup.with_sketches(spark.createDataFrame(rows, "id bigint, name string, phoneNumber string, email string"))
    left, right = (made.select(*[F.col(c).alias(f"{side}_{c}") for c in made.columns]) for side in "lr")
    pairs = left.crossJoin(right).select("l_name", "r_name", dedup._most_similar("name").alias("most"))
    found = pairs.select("most", dedup.field_similarity(F.col("l_name"), F.col("r_name")).alias("score")).collect()
    assert all(row["most"] >= row["score"] - 1e-9 for row in found)
    # Repeated letters count: "aaaa" holds no more than one letter of "a".
    most = {(row["l_name"], row["r_name"]): row["most"] for row in pairs.where("l_name in ('a', 'aaaa')").collect()}
    assert most["aaaa", "a"] == 40.0 and most["a", "a"] == 100.0


def test_tiles_are_dealt_over_the_tasks_that_their_pairs_ask_for(spark):
    """Few bytes make many pairs, so Spark's choice by bytes would leave them to one task."""
    rows = spark.range(400).selectExpr("cast(id % 40 as string) as key", "id as l_id")
    other = rows.withColumnRenamed("l_id", "r_id")
    met = dedup.tiled_join(rows, other, "key", "l_id", "r_id", 3, tasks=13)
    assert met.count() == 4_000 and met.dropDuplicates().count() == 4_000
    assert met.rdd.getNumPartitions() == 13


def test_tidy_texts_score_as_the_texts_they_come_from(spark):
    texts = [None, "", "  ", "Amine", " amine ", "ÉLODIE İ", "karim benali", "x" * 70]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    tidy = dedup.tidy_similarity(F.lower(F.trim("a")), F.lower(F.trim("b")))
    rows = df.select(dedup.field_similarity(F.col("a"), F.col("b")).alias("x"), tidy.alias("y")).collect()
    assert all(r.x == r.y for r in rows) and {0.0, 100.0} < {r.x for r in rows}


@pytest.mark.parametrize("missing", [False, True])
def test_dense_cells_are_scored_like_others(spark, monkeypatch, missing):
    rng = random.Random(11)
    stems = ["amine benali", "amin benali", "karima zid", "x" * 70, "y" * 64 + "z", "é\0b", "", None]
    rows = []
    for i in range(400):
        name = rng.choice(stems)
        name = name if not name or rng.random() < 0.3 else name[: rng.randrange(1, len(name) + 1)] + rng.choice(["", "a", "ب"])
        phone = rng.choice([None, "", "+2135500" + str(rng.randrange(100, 140))])
        mail = rng.choice([None, "", f"a{rng.randrange(9)}@x.dz", "longer.address@example.org"])
        rows.append((i, name, phone, rng.choice([None, 5, 6]), mail, rng.choice(["oran", "alger", None])))
    df = spark.createDataFrame(rows, "row_id bigint, name string, phoneNumber string, DOB bigint, email string, wilaya string")
    settings = replace(SETTINGS, missing_dob_matches=missing, tile_rows=37)
    found = []
    for most in (10, 1_000_000_000):
        monkeypatch.setattr(dedup, "DENSE_PAIRS", most)
        result = dedup.fuzzy_pairs(df, settings)
        found.append(sorted(map(tuple, result.links.select("l_id", "r_id", "l_n", "r_n", "score", "reason").collect())))
    assert found[0] == found[1] and len(found[0]) > 20


def test_pairs_under_dense_keys_are_not_spelled_out(spark, monkeypatch):
    monkeypatch.setattr(dedup, "DENSE_PAIRS", 1_000)
    rows = [(i, f"person {i % 7}", f"+21355000{i:04d}", 5, None, "oran") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, name string, phoneNumber string, DOB bigint, email string, wilaya string")
    bounds = dedup.Bounds(SETTINGS.duplicate_weights, SETTINGS.duplicate_threshold)
    tuples, dense = dedup.materialise(dedup.match_tuples(dedup.match_rows(df, bounds)), "tuples"), []
    assert dedup.candidate_pairs(tuples, bounds, SETTINGS, dense).count() == 0
    assert [some.count() > 0 for some in dense] == [True]


def test_cells_somewhat_larger_are_compared_in_tiles(spark, monkeypatch):
    """One day, one province, more people than ``bucket_rows``: keys of phones and e-mails would spell out more pairs than there are."""
    rows = [(i, f"person {i % 7}", f"+2135500{i * 37 % 10000:04d}", 5, f"person.{i % 7}.{i}@x.dz", "oran") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = replace(SETTINGS, bucket_rows=50)
    monkeypatch.setattr(dedup, "DENSE_PAIRS", 1_000)
    bounds = dedup.Bounds(SETTINGS.duplicate_weights, SETTINGS.duplicate_threshold)
    tuples, dense = dedup.materialise(dedup.match_tuples(dedup.match_rows(df, bounds)), "tuples"), []
    assert dedup.candidate_pairs(tuples, bounds, settings, dense).count() == 0
    found = {(r["l_id"], r["r_id"]): r["score"] for some in dense for r in some.where("_once").collect()}
    assert found == pytest.approx(brute_force(rows, settings)) and len(found) > 1_000
    # Nobody without a province was born that day, so there is no common cell.
    assert {r["cell"] for r in dedup._cells(tuples, bounds).collect()} == {"5|=|oran"}


def test_numbers_in_order_move_no_row_once_they_are_sorted(spark):
    from recordloom.operators.ordering import dense_index

    df = spark.range(1_000).selectExpr("(id * 7919) % 1009 as a", "id as b").repartition(7)
    numbered = dense_index(df, ["a", "b"], "place", start=5)
    assert [r["place"] for r in numbered.orderBy("a", "b").collect()] == list(range(5, 1_005))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_pairs_are_numbered_without_a_second_copy(spark):
    """Links are written once; what numbers them is one row for each left person."""
    result = find_duplicates(spark.createDataFrame(people(11, 60), SCHEMA), SETTINGS)
    assert not any("/ranges-" in file for file in result.pairs.inputFiles())
    found = result.pairs.orderBy("left_id", "right_id").collect()
    numbers = [int(row["group_id"][4:]) for row in found]
    assert numbers == list(range(numbers[0], numbers[0] + len(found))) and len({row["left_id"] for row in found}) < len(found)
