import re
from collections import defaultdict

import pytest

from recordloom.llm.mixing import mix, mix_digest


def targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in stopped else level * weight[s] for s in order}
        stopped |= more


def check(docs):
    rows, source = mix_digest(docs).collect(), defaultdict(int)
    words = [(d.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")), d.source) for d in docs.collect()]
    for _, size, of in words:
        source[of] += size
    want = targets(source)
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 3)) for r in rows) == sorted(
        (str(i), size, source[of], round(want[of], 3)) for i, size, of in words)
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    assert sum(want.values()) == pytest.approx(sum(source.values()))
    again = {(r.doc_id, r.taken) for r in mix_digest(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    emitted = mix(docs)
    assert emitted.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in emitted.collect()) == sum(r.taken for r in rows)


def test_targets_and_copies(documents, odd):
    check(documents)
    check(odd)


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "array_join(array_repeat('w', 20), ' ') as text",
                                          "concat('s', if(id % 3 = 0, 0, id % 7)) as source")
    per = mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        {"target": "max", "taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.05 for r in per)


def test_empty_and_wordless_tables(empty, odd):
    assert mix_digest(empty).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in mix_digest(odd.where("doc_id < 3")).collect())
