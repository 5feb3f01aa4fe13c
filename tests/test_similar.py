"""The index of rarest letter pairs against comparing all with all."""

import random
from dataclasses import replace
from datetime import datetime, timezone

import pytest

from recordloom.config import Settings
from recordloom.functions.similarity import ratio
from recordloom.operators import dedup
from recordloom.operators.dedup import fuzzy_pairs
from recordloom.operators.similar import Bound, elements, keys_of, meeting_pairs, similar_pairs
from tests.test_dedup import SCHEMA, brute_force

SETTINGS = Settings(as_of=datetime(2026, 1, 1, tzinfo=timezone.utc))


def texts(rnd, n, letters, longest):
    made = []
    for _ in range(n):
        if made and rnd.random() < 0.6:
            text = list(rnd.choice(made))
            for _ in range(rnd.randrange(1, 5)):
                at = rnd.randrange(len(text) + 1)
                text[at:at + rnd.randrange(3)] = rnd.choices(letters, k=rnd.randrange(3))
            made.append("".join(text) or rnd.choice(letters))
        else:
            made.append("".join(rnd.choices(letters, k=rnd.randrange(1, longest))))
    return sorted(set(made))


@pytest.mark.parametrize("least", [30.0, 60.0, 78.75, 85.0, 95.0, 100.0])
def test_qualifying_texts_share_a_key(least):
    """Thousands of pairs of every length, also repeated letters and signs beyond 16 bits."""
    import numpy as np

    rnd = random.Random(least)
    bound = Bound(least)
    often = np.array([rnd.randrange(50) for _ in range(1 << 16)])
    for letters, longest in (("ab", 9), ("abcdefgh", 25), ("aeinrst \U0001f600é", 60)):
        found = texts(rnd, 160, letters, longest)
        keys = [set(keys_of(t, bound, often).tolist()) for t in found]
        for i, a in enumerate(found):
            for j in range(i):
                if ratio(a, found[j]) >= least:
                    assert keys[i] & keys[j], (a, found[j])


def test_elements():
    assert elements("aab", True) == ["\x02a", "aa", "ab", "b\x03"] and elements("aab", False) == ["a", "a\x001", "b"]
    assert keys_of("x", Bound(85.0), [0] * (1 << 16)).size == 1


@pytest.mark.parametrize("least", [40.0, 78.75, 90.0])
def test_pairs_equal_all_with_all(spark, least):
    rnd = random.Random(1)
    left = [(g, t, g == "own") for g in ("own", "star") for t in texts(rnd, 120, "abcdeil ", 14)]
    right = [(g, t) for g, t, _ in left if g == "own"] + [("star", t) for t in texts(rnd, 120, "abcdeil ", 14)]
    found = similar_pairs(spark.createDataFrame(left, "group string, text string, half boolean"),
                          spark.createDataFrame(right, "group string, text string"), least, tile_rows=7).collect()
    want = {(g, a, b) for g, a, half in left for h, b in right if g == h and a != b and (not half or a < b) and ratio(a, b) >= least}
    assert sorted(tuple(r) for r in found) == sorted(want) and want


def born_on_one_day(rnd, n):
    """People with names, phones and e-mails of their own; every third is a near copy of an earlier one."""
    rows = []
    for i in range(n):
        name = " ".join("".join(rnd.choices("abcdefghiklmnorstuyz", k=rnd.randrange(4, 9))) for _ in range(2))
        phone, mail = f"+213{rnd.choice('567')}{rnd.randrange(10**8):08d}", f"{name[:3]}.{rnd.randrange(10**6)}@{rnd.choice(['gmail.com', 'yahoo.fr'])}"
        if rows and i % 3 == 0:
            _, name, phone, _, mail, _ = rnd.choice(rows)
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(name))
                name = name[:at] + rnd.choice(["", "e", "ll"]) + name[at + 1:]
            if rnd.random() < 0.6:
                phone = phone[:5] + "".join(rnd.sample(phone[5:], len(phone) - 5))
            mail = mail if rnd.random() < 0.5 else f"x{rnd.randrange(99)}{mail}" if rnd.random() < 0.8 else None
        rows.append((i, name, phone, 378691200, mail, rnd.choice(["Oran", "Oran", "Oran", None])))
    return rows


def test_a_large_cell_with_mails_equals_brute_force(spark):
    rows = born_on_one_day(random.Random(2), 400)
    settings = replace(SETTINGS, bucket_rows=50, tile_rows=32)
    got = {(r["left_id"], r["right_id"]): r["score"] for r in fuzzy_pairs(spark.createDataFrame(rows, SCHEMA), settings).pairs.collect()}
    want = brute_force(rows, settings)
    assert got == pytest.approx(want)
    # Pairs with other phones are among them, and such with other names too.
    far = [(a, b) for a, b in want if ratio(rows[a][2], rows[b][2]) < 80]
    assert len(far) > 10 and any(ratio(rows[a][1], rows[b][1]) < 80 for a, b in want)


def test_met_pairs_grow_with_a_cell_and_not_with_its_square(spark):
    """Twice as many people of one day make some twice as many meetings of names, most of them near copies under several keys."""
    met = []
    for n in (2_500, 5_000):
        names = spark.createDataFrame([("day", r[1], True) for r in born_on_one_day(random.Random(3), n)], "group string, text string, half boolean").distinct()
        met.append(meeting_pairs(names, names.select("group", "text"), 78.75, 4_096).count())
    assert met[1] < 2.8 * met[0] and met[1] < 5_000 ** 2 / 2 / 15


def test_weights_that_force_nothing_keep_the_cell_whole(spark):
    rows = born_on_one_day(random.Random(4), 80)
    settings = replace(SETTINGS, duplicate_weights={"name": 0.05, "phoneNumber": 0.45, "DOB": 0.2, "email": 0.3}, duplicate_threshold=60.0, bucket_rows=5)
    assert dedup.Bounds(settings.duplicate_weights, 60.0).needs("phoneNumber")
    got = {(r["left_id"], r["right_id"]) for r in fuzzy_pairs(spark.createDataFrame(rows, SCHEMA), settings).pairs.collect()}
    assert got == set(brute_force(rows, settings))
