from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from recordloom.llm.components import components
from recordloom.llm.near_duplicates import NearDup, drop_near_duplicates, near_duplicates


def shingles(text, words):
    tokens = (text or "").encode().lower().split()
    return frozenset(tuple(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()


def expected(rows, words):
    """Components by brute force over an inverted index of whole sets."""
    sets = [shingles(r.text, words) for r in rows]
    above = list(range(len(sets)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    index = defaultdict(list)
    for i, grams in enumerate(sets):
        shared = Counter(j for g in grams for j in index[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(grams) + len(sets[j]) - n):
                above[root(i)] = root(j)
        for g in grams:
            index[g].append(i)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return [(str(r.doc_id), len(sets[i]), least.get(root(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows)]


def check(docs, words):
    rows = near_duplicates(docs, NearDup(words=words)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows) == sorted(expected(docs.collect(), words))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(documents, odd, words):
    check(documents, words)
    check(odd, words)


def test_large_group_of_near_copies_and_a_chain(spark):
    """200 copies with one word changed each, 30 links of a chain whose ends are unlike, and short ties."""
    docs = spark.sql("""
        select id as doc_id, array_join(transform(sequence(1, 60), i -> if(i = 1 + id % 60, concat('x', id), concat('w', i))), ' ') as text
        from range(200)
        union all select 1000 + id, array_join(transform(sequence(id * 4, id * 4 + 99), i -> concat('c', i)), ' ') from range(30)
        union all select 2000 + id, element_at(array('of the', 'Of THE', 'of', 'the of', 'of the of', ''), cast(1 + id % 6 as int)) from range(24)""")
    check(docs, 2)
    kept = {r.doc_id for r in drop_near_duplicates(docs, NearDup(words=2)).collect()}
    want = {r.doc_id for r in near_duplicates(docs, NearDup(words=2)).collect() if r.kept or r.n_shingles == 0}
    assert kept == want


def test_one_of_each_group_stays_with_all_columns(odd, empty):
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, None, 7, 9, 10, 11, 12]))
    assert drop_near_duplicates(empty).collect() == [] and near_duplicates(empty).collect() == []


def test_components_by_contraction(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(60, 90)] + [(200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{x: 60 for x in [*range(60, 90), 100]}, 200: 200}


def test_near_copies_below_the_threshold_are_ruled_out_before_they_are_confirmed(spark, monkeypatch):
    """40 texts that share 170 of 200 shingles, pair by pair a similarity of 0.74: next to no pair of them is spelled out."""
    from recordloom.llm import near_duplicates as nd

    docs = spark.sql("""
        select id as doc_id, array_join(transform(sequence(1, 201), i -> if(i <= 171, concat('w', i), concat('x', id, '_', i))), ' ') as text
        from range(40)""")
    seen, confirmed = [], nd.confirmed
    monkeypatch.setattr(nd, "confirmed", lambda pairs, sets, how: seen.append(pairs.count()) or confirmed(pairs, sets, how))
    check(docs, 2)
    assert max(seen, default=0) <= 8  # of 780


def test_odd_bits_differ_in_no_more_places_than_their_sets():
    import numpy as np

    from recordloom.llm.near_duplicates import odd_bits

    draw = np.random.default_rng(5)
    for size in (0, 1, 30, 500, 6_000):
        pool = draw.integers(0, 2**64, size + 40, dtype=np.uint64)
        a, b = np.unique(pool[:size]), np.unique(pool[-size:] if size else pool[:0])
        apart = int(np.bitwise_count((odd_bits(a, 2_048) ^ odd_bits(b, 2_048)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b)) and odd_bits(a, 2_048).shape == (32,)


def test_whole_texts_travel_in_small_batches(spark):
    docs = spark.range(0, 1_000, 1, 1).selectExpr("id as doc_id", "concat(id, repeat(' word', 2000)) as text")
    near_duplicates(docs).count()

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["size"])

    found = [row["size"] for row in docs.mapInArrow(sizes, "size bigint").collect()]
    assert sum(found) > 10_000_000 and max(found) < 2_000_000
