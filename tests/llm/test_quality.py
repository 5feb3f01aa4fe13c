import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from recordloom.llm.quality import binomial_tail, quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def check(docs, labels):
    rows = quality(docs, labels).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((str(d.doc_id), *base(d.text)) for d in docs.collect())
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    return rows


def test_figures_equal_brute_force(spark, documents, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    check(documents, labels)
    check(odd, labels)
    assert quality(empty, labels).collect() == []
    assert all(r.kept != r.base_failed for r in check(odd, labels.where("false")))


def test_repeats(spark):
    texts = ["a b c d e " * 3, "a a a a a a a", "a b c d e x a b c d e f b c d e f", "a b c d e\na b c d e\n\n \n", "a b c d"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en")),
          spark.createDataFrame([], "doc_id bigint, quality int"))


def test_binomial_tail_is_exact(spark):
    cases = [(n, k, p) for n in (1, 20, 500) for k in range(0, n + 1, max(1, n // 20)) for p in (0.003, 0.1)]
    for n, k, p in cases:
        got = spark.range(1).select(binomial_tail(F.lit(float(n)), F.lit(k), p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
        assert abs(got - want) < 1e-9 * max(1, want)


def test_cutoffs_reject_junk_and_hold_the_risk(spark):
    """20,000 labelled documents: good ones have few symbols, bad ones many."""
    docs = spark.range(20_000).selectExpr(
        "id as doc_id", "'en' as lang",
        """array_join(transform(sequence(1, 30), i -> concat('word', pmod(xxhash64(id, i), 997),
           if(id % 5 = 0 or pmod(xxhash64(i, id), 100) = 0, '$$$', ''))), ' ') as text""")
    labels = docs.selectExpr("doc_id", "if(doc_id % 5 = 0, 0, 1) as quality").where("doc_id % 2 = 0")
    kept = quality(docs, labels).groupBy((F.col("doc_id") % 5 == 0).alias("junk")).agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.junk: r.share for r in kept}
    assert share[True] == 0 and share[False] >= 0.98


def test_a_few_hundred_labels_certify_cutoffs(spark):
    docs = spark.range(4_000).selectExpr(
        "id as doc_id", "if(id % 2 = 0, 'de', 'fr') as lang",
        "array_join(transform(sequence(1, 30), i -> concat('word', pmod(xxhash64(id, i), 997), if(id % 5 = 0, '$$$', ''))), ' ') as text")
    labels = docs.selectExpr("doc_id", "if(doc_id % 5 = 0, 0, 1) as quality").where("doc_id < 800")
    kept = quality(docs, labels).groupBy((F.col("doc_id") % 5 == 0).alias("junk")).agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.junk: r.share for r in kept}
    assert share[True] == 0 and share[False] >= 0.98
