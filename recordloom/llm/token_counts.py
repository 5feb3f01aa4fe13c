"""Token counts of whole texts with a two-tier table of pre-token lengths.

A piece model never merges across the start of a white-space run, so a text is cut there into pre-tokens and its
count is the sum over them.  A first pass finds the frequent pre-tokens: every partition keeps a bounded summary and
hands on its heaviest entries only, so no pre-token of a text is ever shuffled.  Their lengths form a table of at
most ``frequent`` entries, which is broadcast.  The second pass looks pre-tokens up there, encodes the misses, and
keeps them in a bounded cache of its worker.  The table only saves time; every count is the model's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
FREQUENT = 16_384
SUMMARY = 2_000
COUNTED = 200_000
CACHED = 300_000
LONGEST_CACHED = 64
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


@cache
def model(name: str) -> sentencepiece.SentencePieceProcessor:
    """The model of this process; checks that pre-tokens may be encoded alone."""
    loaded = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    crossing = re.compile(f"[^{SPACE}]{SPACE}|\n")
    if any(crossing.search(loaded.id_to_piece(i)) for i in range(loaded.get_piece_size())):
        raise ValueError(f"{name} merges across white space; it has no separate pre-tokens")
    if loaded.encode("\n", out_type=str) != [SPACE, "<0x0A>"] or loaded.encode("  ", out_type=str) != [SPACE * 3]:
        raise ValueError(f"{name} rewrites white space; its pre-tokens can't be cut from the text")
    return loaded


def pre_tokens(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """Per line: words after one space each (without it), and units to be taken as they are."""
    for line in (SPACE + text.replace(" ", SPACE)).split("\n"):
        if SPACE * 2 in line:
            yield [], UNITS(line)
        else:
            first, *words = line.split(SPACE)
            yield words, [first] if first else []


class Lengths(dict):
    """Pre-token -> number of tokens; misses are encoded and cached."""

    def __init__(self, name: str, prefix: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.encode, self.prefix, self.frequent = model(name).encode, "\n" + prefix, frequent

    def __missing__(self, unit: str) -> int:
        # The model puts a space first; a newline after it keeps the unit apart from both.
        length = len(self.encode(self.prefix + unit)) - 2
        if len(unit) <= LONGEST_CACHED:
            if len(self) > CACHED:
                self.clear()
                self.update(self.frequent)
            self[unit] = length
        return length


def frequent_words(docs: DataFrame, size: int) -> list[str]:
    """The most frequent words of all texts, at most ``size``, out of bounded summaries of the partitions."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                for words, _ in pre_tokens(text.as_py() or ""):
                    seen.update(words)
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(word, n) for word, n in seen.most_common(SUMMARY) if len(word) <= LONGEST_CACHED]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    heavy = docs.select("text").mapInArrow(summarise, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [row["word"] for row in heavy.orderBy(F.desc("n"), "word").limit(size).collect()]


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", limit: int = 4096,
                 frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes and no tokens.  Repeated rows are counted each.  No begin or end token is
    added, nothing is truncated, and special strings inside a text are ordinary text to this model.  Other columns
    are left out.
    """
    docs = docs.select("doc_id", "text")
    words = frequent_words(docs, frequent)
    spaced = Lengths(name, SPACE, {})
    table = docs.sparkSession.sparkContext.broadcast({word: spaced[word] for word in words})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after_space, as_is = Lengths(name, SPACE, table.value), Lengths(name, "", {})
        for batch in batches:
            totals = []
            for text in batch.column("text"):
                total = -1
                for words, units in pre_tokens(text.as_py() or ""):
                    total += 1 + sum(map(after_space.__getitem__, words)) + sum(map(as_is.__getitem__, units))
                totals.append(total if text.as_py() else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return sized.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit)
