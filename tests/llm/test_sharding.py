import zlib
from collections import Counter, defaultdict

import pytest

from recordloom.llm.sharding import balanced_shards


def check(docs, shards=40):
    rows = balanced_shards(docs, shards).collect()
    texts = docs.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(d.doc_id), len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in texts)
    held = Counter(r.shard for r in rows)
    counts = [held[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows


def test_counts_are_even_and_slots_gapless(documents, odd):
    check(documents)
    check(odd)


@pytest.mark.parametrize("copies, share", [(6, 1), (300, 1)])
def test_equal_texts_share_a_shard_or_as_few_as_hold_them(spark, copies, share):
    docs = spark.range(600).selectExpr("id as doc_id", f"if(id < {copies}, 'same', if(id < 400, concat('p', id div 2), concat('t', id))) as text")
    rows = check(docs, 10)
    used = {r.shard for r in rows if r.doc_id < copies}
    assert len(used) <= -(-copies // 60) + 1
    pairs = defaultdict(set)
    for r in rows:
        if copies <= r.doc_id < 400:
            pairs[r.doc_id // 2].add(r.shard)
    assert sum(len(s) == 1 for s in pairs.values()) >= 0.9 * len(pairs) if copies < 300 else True


def test_empty_table(empty):
    assert balanced_shards(empty).collect() == []


@pytest.mark.parametrize("text, whole", [
    ("concat('p', id div 2)", 1.0),
    ("concat('q', id % 175)", 0.94),  # triples and fours, no room beside them
    ("if(id < 250, 'same', concat('p', id div 2))", 1.0),
])
def test_groups_stay_whole_where_every_text_has_a_copy(spark, text, whole):
    docs = spark.range(600).selectExpr("id as doc_id", f"{text} as text")
    rows = check(docs, 10)
    text_of = {d.doc_id: d.text for d in docs.collect()}
    used = defaultdict(set)
    for r in rows:
        used[text_of[r.doc_id]].add(r.shard)
    assert len(used.pop("same", ())) <= 5
    assert sum(len(s) == 1 for s in used.values()) >= whole * len(used)
