"""URL verdicts: rules first, then naive Bayes over the words of host and path.

Names in hosts are split into words by Viterbi's algorithm over a unigram model; the model is counted over the texts and
paths of all pages and the parts of hyphenated host labels.  Hosts in which a seed word turns up label their URLs, and
a multinomial naive Bayes model over all URLs, with words hashed to ``buckets``, says which other words go with those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.balance import salted_join
from recordloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SEED_WORDS = ("adult", "ads", "bet", "bets", "betting", "casino", "escort", "malware", "phishing", "pills", "poker", "porn",
              "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx")
RUNS = r"\p{L}+|[0-9]+"
# A label of a host name has 63 characters at most; a longer run of letters is no name and stays one word.
LABEL = 63


@dataclass(frozen=True)
class UrlFilter:
    """Rules (verdict, host and path) that decide alone, words that make a host an example of the blocked class, the longest
    word of the unigram model, how often a seed word counts at least (a share of all words), how many words of the whole smooth each class, and the model's size."""

    rules: tuple[tuple[str, str], ...] = RULES
    seeds: tuple[str, ...] = SEED_WORDS
    longest: int = 24
    seed_share: float = 1e-5
    smoothing: float = 100.0
    buckets: int = 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct (size, verdict, rule); of equally long ones that which blocks; or null."""
    found = [F.lit(None).cast("struct<size:int,verdict:string,rule:string>")]
    for verdict, rule in rules:
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*found))


def runs(text: Column) -> Column:
    """Runs of letters, lowered; a run of digits is ``0``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(0))
    return F.transform(found, lambda run: F.when(run.rlike("^[0-9]"), F.lit("0")).otherwise(run))


def word_counts(pages: DataFrame, hosts: DataFrame, how: UrlFilter) -> DataFrame:
    """(word, n): the unigram model."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*+>", " ")
    texts = pages.select(F.explode(F.array_remove(F.split(F.lower(visible), r"[^\p{L}]+"), "")).alias("word"))
    paths = pages.select(F.explode(runs(F.col("path"))).alias("word"))
    # A hyphen inside a label parts words; each host says so once.
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).where(F.col("label").contains("-"))
    parts = labels.select(F.explode(runs(F.col("label"))).alias("word"))
    counted = texts.union(paths).union(parts).where((F.length("word") <= how.longest) & (F.col("word") != "0"))
    return counted.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(run: str, known: dict[str, float], total: float, longest: int) -> list[str]:
    """The most likely words of a run; an unknown word costs the more the longer it is, ties go to the longer last word."""
    best, cut = [0.0], [0]
    for end in range(1, len(run) + 1):
        choices = []
        for start in range(0, end):
            word = run[start:end]
            if end - start <= longest and word in known:
                choices.append((best[start] + math.log(known[word] / total), -start))
            else:
                choices.append((best[start] + math.log(10 / total) - (end - start) * math.log(10), -start))
        score, start = max(choices)
        best.append(score), cut.append(-start)
    words, end = [], len(run)
    while end:
        words.append(run[cut[end]:end])
        end = cut[end]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame, total: float, how: UrlFilter) -> DataFrame:
    """(run, words) of distinct runs: all parts of a run are looked up in the unigram model by a join."""
    short = names.where(F.length("run") <= LABEL)
    parts = (
        short.withColumn("_from", F.explode(F.sequence(F.lit(1), F.length("run"))))
        .withColumn("_size", F.explode(F.sequence(F.lit(1), F.least(F.lit(how.longest), F.length("run") - F.col("_from") + 1))))
        .select("run", F.substr("run", F.col("_from"), F.col("_size")).alias("word")).distinct()
    )
    known = parts.groupBy("word").agg(F.count("*").alias("_n")).join(counts, "word")
    found = salted_join(parts, known, "word", F.xxhash64("run"))
    # A run of LABEL letters has LABEL * longest parts at most.
    asked = found.groupBy("run").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = total * how.seed_share
        for batch in batches:
            split = []
            for name, known in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist()):
                held = {k["word"]: float(k["n"]) for k in known}
                held |= {seed: max(held.get(seed, 0.0), least) for seed in how.seeds if seed in name}
                split.append(viterbi(name, held, total, how.longest))
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(split, pa.list_(pa.string()))], ["run", "words"])

    whole = names.where(F.length("run") > LABEL).select("run", F.array("run").alias("words"))
    return asked.mapInArrow(run, "run string, words array<string>").union(whole)


def host_words(pages: DataFrame, how: UrlFilter) -> DataFrame:
    """(host, words, seeded, _n): the words of each host in order, whether a seed is among them, its number of pages."""
    hosts = materialise(pages.groupBy("host").agg(F.count("*").alias("_n")), "hosts")
    counts = materialise(word_counts(pages, hosts, how), "words")
    total = float(max(counts.agg(F.sum("n")).first()[0] or 0, 1_000))
    named = hosts.select("host", F.posexplode(runs(F.col("host"))).alias("_at", "run"))
    names = named.groupBy("run").agg(F.count("*").alias("_n"))
    split = segmented(names.where("run <> '0'").select("run"), counts, total, how).join(names, "run")
    split = salted_join(named, materialise(split, "split"), "run", F.xxhash64("host", "_at"))
    words = split.groupBy("host").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", F.coalesce("words", F.array("run")).alias("words")))), lambda p: p["words"])).alias("words"))
    words = hosts.join(words, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return words.withColumn("seeded", F.arrays_overlap("words", F.array(*[F.lit(s) for s in how.seeds])) if how.seeds else F.lit(False))


def buckets_of(words: list[str], how: UrlFilter) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode()) % how.buckets for w in words], np.int64)


def log_odds(urls: DataFrame, how: UrlFilter) -> tuple[float, np.ndarray]:
    """Prior and weight of each bucket: how much likelier its words are in the blocked class.

    Tasks count their own rows; what they send is bounded by the size of the model, as is what the driver gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, how.buckets + 1), np.int64)
        for batch in batches:
            for own, seeded in ((held[0], False), (held[1], True)):
                rows = batch.filter(pc.equal(batch.column("seeded"), seeded))
                own[-1] += rows.num_rows
                coded = rows.column("words").flatten().dictionary_encode()
                each = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) if len(coded) else []
                np.add.at(own, buckets_of(coded.dictionary.to_pylist(), how), each)
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0][at]), pa.array(held[1][at])], ["bucket", "allowed", "blocked"])

    found = urls.select("words", "seeded").mapInArrow(run, "bucket bigint, allowed bigint, blocked bigint").groupBy("bucket").agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).toArrow()
    counts = np.zeros((2, how.buckets + 1))
    counts[0][found["bucket"].to_numpy()], counts[1][found["bucket"].to_numpy()] = found["allowed"], found["blocked"]
    (allowed, blocked), words = counts[:, -1], counts[:, :-1]
    # Each class is given some words of the whole beforehand, so what was seen too seldom to tell says next to nothing.
    whole = how.smoothing * words.sum(axis=0) / max(words.sum(), 1.0)
    likely = (words + whole) / (words.sum(axis=1, keepdims=True) + how.smoothing)
    seen = whole > 0
    weights = np.zeros(how.buckets)
    weights[seen] = np.log(likely[1][seen]) - np.log(likely[0][seen])
    return math.log((blocked + 1) / (allowed + 1)), weights


def scores(urls: DataFrame, prior: float, weights: np.ndarray, how: UrlFilter) -> DataFrame:
    """``urls`` (page_id, host, path, words) with the log-odds of the blocked class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            coded = words.flatten().dictionary_encode()
            each = weights[buckets_of(coded.dictionary.to_pylist(), how)][coded.indices.to_numpy()] if len(coded) else np.zeros(0)
            odds = prior + np.bincount(pc.list_parent_indices(words).to_numpy(), each, len(words))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path")] + [pa.array(odds)],
                                             ["page_id", "host", "path", "log_odds"])

    return urls.select("page_id", "host", "path", "words").mapInArrow(run, "page_id bigint, host string, path string, log_odds double")


def url_verdicts(pages: DataFrame, how: UrlFilter = UrlFilter()) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, log_odds.

    A null URL and one without ``://`` have an empty host and path; without any word the prior decides, so they are blocked
    only where most URLs are.  A null html has no words.  Other columns play no part; an empty table gives no row.
    """
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    hosts = host_words(parsed, how)
    urls = salted_join(parsed.drop("html"), materialise(hosts, "host-words"), "host", F.xxhash64("page_id", "path"))
    urls = urls.select("page_id", "host", "path", F.concat("words", runs(F.col("path"))).alias("words"), "seeded")
    urls = materialise(urls, "urls")
    prior, weights = log_odds(urls, how)
    judged = scores(urls, prior, weights, how).withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), how.rules))
    own = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", own).alias("verdict"), "log_odds")
