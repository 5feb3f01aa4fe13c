import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from recordloom.llm import phrases as module
from recordloom.llm.phrases import Phrases, frequent_phrases, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, how):
    """Occurrences of all phrases by language, one by one."""
    found, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, how.longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang][tuple(words[i:i + k])] += 1
    return {lang: {p: n for p, n in f.items() if n >= how.least} for lang, f in found.items()}, totals


def expected(rows, how):
    found, totals = counts(rows, how)
    out = []
    for lang, f in found.items():
        kept, longer = [], Counter()
        for p, n in f.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], n)
        for p, a in f.items():
            if len(p) > 1:
                if not (longer[p] and 100 * longer[p] >= how.inside * a):
                    score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                    kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:how.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def check(docs, how):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    want = expected(rows, how)
    assert sorted(tuple(r) for r in phrases(docs, how).collect()) == want
    return want


@pytest.mark.parametrize("how", [
    Phrases(), Phrases(least=5, sample_one_in=3), Phrases(least=3, inside=50, top=7, sample_one_in=100, filter_bits=8),
    Phrases(least=40, longest=3, sample_one_in=1, sample_least=10)])
def test_lists_equal_brute_force(documents, how):
    """Whatever the sample proposes (nearly nothing, or all) and however full its bitmap is."""
    assert check(documents, how)


def test_odd_rows(odd, empty):
    assert check(odd, Phrases(least=2))
    assert phrases(empty).collect() == []
    assert phrases(odd.where("text is null or trim(text) = ''")).collect() == []


def test_pieces_case_and_overlaps(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([
        ("a a a a, a a\ta", None), ("New York. new york;NEW  YORK new\nyork", "en"), ("É é É é", "fr"), ("x\u00a0y x\u00a0y z", "und")])],
        "doc_id bigint, text string, lang string")
    found = {(r.lang, r.phrase): r.n for r in frequent_phrases(docs, Phrases(least=1)).collect()}
    assert found[("und", "a a")] == 5 and found[("und", "a a a a")] == 1 and found[("und", "")] == 10
    assert found[("en", "new york")] == 3 and ("en", "york new york") not in found
    assert found[("fr", "é É")] == 1 and found[("und", "x\u00a0y x\u00a0y")] == 1
    check(docs, Phrases(least=1, inside=101))


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    """A phrase across a cut is counted once, one inside the words carried over is not counted again."""
    text = " ".join(f"w{i % 7} {'x' * (i % 5)}{',' if i % 11 == 0 else ''}" for i in range(400))
    monkeypatch.setattr(module, "BLOCK_BYTES", 64)
    found = Counter()
    for block in module.blocks([text.encode(), b"w1 w2", text.encode()], 3, 4):
        for k in range(1, len(block.keys) + 1):
            at = block.new(k).nonzero()[0]
            found.update(tuple(p.split(" ")) for p in block.phrases(at, k).to_pylist())
    want, _ = counts([(text, "en"), ("w1 w2", "en"), (text, "en")], Phrases(least=1))
    assert found == want["en"]


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).select(module.score_of(F.lit(10**15), F.lit(10**15 + 1), F.lit(10**18)).alias("s")).first()
    assert row.s == 2_000_000 * 10**15 // (10**15 + 1 + 10**18)
