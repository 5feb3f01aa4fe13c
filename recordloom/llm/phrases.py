"""Collocations per language, counted exactly by Toivonen's sampling.

A sample of the documents proposes phrases: those it holds ``sample_least`` times.  One pass over all documents then
counts, besides every word, the phrases whose two parts without the last and without the first word were both
proposed: these are the proposed phrases and their negative border, so each proposed phrase and each smallest phrase
that was not proposed gets its exact count.  Where a phrase of the border is frequent the border has failed: it joins
the proposed ones, and a further pass counts what only now has both parts proposed, until no border fails.  A
frequent phrase has frequent parts, so none can be left uncounted at the end, whatever the sample was.

These passes count 64-bit keys of phrases.  A last one counts, and names, the phrases whose key is frequent, text by text, so keys that
two phrases share change nothing.  Sets of keys are bitmaps of fixed size: phrases that share a bit with a member are counted as
well; a full bitmap only means more counting, never another result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.balance import salted_join
from recordloom.session import materialise

BLOCK_BYTES = 1 << 20
ROWS_AT_ONCE = 512
TOP_SALTS = 64
# Ends of pieces become one full stop, a tab a space; A-Z are lowered before.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(PIECE_ENDS + b"\t", b"." * len(PIECE_ENDS) + b" ")


@dataclass(frozen=True)
class Phrases:
    """Least count, longest phrase in words, the share (per cent) a longer phrase may take of a candidate, the length
    of each language's list; one document in ``sample_one_in`` is in the sample, and ``filter_bits`` is the binary
    logarithm of the bitmap's size."""

    least: int = 30
    longest: int = 4
    inside: int = 80
    top: int = 2_000
    sample_one_in: int = 16
    sample_least: int = 2
    filter_bits: int = 26


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


class Block:
    """Words of texts of one language, with the 64-bit keys of the phrases that start at each.

    The first ``skip`` words were carried over from the block before and only serve phrases that reach out of them.
    """

    def __init__(self, tokens: pa.Array, skip: int, lang: int, longest: int):
        self.tokens, self.skip = tokens, skip
        coded = tokens.dictionary_encode()
        hashes = [0 if word == b"." else xxhash.xxh3_64_intdigest(word) or 1
                  for word in coded.dictionary.view(pa.binary()).to_pylist()]
        ids = np.array(hashes, np.uint64)[coded.indices.to_numpy()]
        word = ids != 0
        keys, whole = mixed(ids ^ np.uint64(lang)) & ~np.uint64(7) | np.uint64(1), word
        self.keys, self.whole = [keys], [whole]
        for length in range(2, min(longest, len(ids)) + 1):
            # A key ends with the number of its words.
            keys = mixed(keys[:-1] ^ (ids[length - 1:] * np.uint64(0xC2B2AE3D27D4EB4F))) & ~np.uint64(7) | np.uint64(length)
            whole = whole[:-1] & word[length - 1:]
            self.keys.append(keys), self.whole.append(whole)

    def new(self, length: int) -> np.ndarray:
        """Which places start a whole phrase that does not lie in the words carried over."""
        found = self.whole[length - 1].copy()
        found[:max(0, self.skip - length + 1)] = False
        return found

    def phrases(self, at: np.ndarray, length: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.tokens.take(pa.array(at + i)) for i in range(length)], " ")

    @property
    def words(self) -> int:
        return int(np.count_nonzero(self.new(1)))


def words(text: bytes) -> pa.Array:
    """Words, with a full stop between pieces."""
    spaced = text.lower().translate(PLAIN).replace(b".", b" . ")
    found = pc.ascii_split_whitespace(pa.array([spaced], pa.binary()).view(pa.string())).values
    return found.filter(pc.not_equal(pc.binary_length(found), 0))


def blocks(texts: list[bytes], lang: int, longest: int) -> Iterator[Block]:
    """Blocks of bounded size; no phrase reaches from one text into the next, and long texts are read in slices."""
    waiting, size = [], 0
    for text in texts:
        if len(text) > BLOCK_BYTES:
            yield from sliced(text, lang, longest)
            continue
        waiting.append(text)
        size += len(text)
        if size > BLOCK_BYTES:
            yield Block(words(b".".join(waiting)), 0, lang, longest)
            waiting, size = [], 0
    if waiting:
        yield Block(words(b".".join(waiting)), 0, lang, longest)


def sliced(text: bytes, lang: int, longest: int) -> Iterator[Block]:
    text = text.lower().translate(PLAIN)
    start, carried = 0, pa.array([], pa.string())
    while start < len(text):
        # A slice ends with the next space or end of a piece.
        ends = [at for at in (text.find(b" ", start + BLOCK_BYTES), text.find(b".", start + BLOCK_BYTES)) if at >= 0]
        end = min(ends) + 1 if ends else len(text)
        tokens = pa.concat_arrays([carried, words(text[start:end])])
        yield Block(tokens, len(carried), lang, longest)
        start, carried = end, tokens.slice(max(0, len(tokens) - longest + 1))


class Keys:
    """A set of keys as a bitmap; it may hold more than was put in."""

    def __init__(self, keys: DataFrame, bits: int):
        self.bits = bits
        slot = F.shiftrightunsigned("key", 64 - bits)
        rows = (
            keys.select(F.shiftright(slot, 6).alias("at"), F.pmod(slot, F.lit(64)).cast("int").alias("_bit"),
                        F.expr("cast(1 as bigint)").alias("_one"))
            .groupBy("at").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("held"))
        )
        # At most 2 ** (bits - 6) rows whatever the input.
        found = rows.toArrow()
        self.map = np.zeros(1 << (bits - 6), np.uint64)
        self.map[found["at"].to_numpy()] = found["held"].to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.bits)
        return (self.map[(slot >> np.uint64(6)).astype(np.intp)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

    def parts(self, block: Block, length: int) -> np.ndarray:
        """Where a phrase of ``length`` words stands whose parts of one word less are both proposed."""
        held = self.holds(block.keys[length - 2]) & block.whole[length - 2]
        return held[:-1] & held[1:]


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes]]]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary())):
            texts.setdefault(lang, []).append(text.as_py())
        for lang, own in texts.items():
            yield lang, xxhash.xxh3_64_intdigest(lang.encode()), own


def key_counts(texts: DataFrame, longest: int, chosen) -> DataFrame:
    """(key, n) of the phrases at the places that ``chosen`` (block, length) names in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, seed, own in by_language(batch):
                for block in blocks(own, seed, longest):
                    keys = [k[chosen(block, i + 1)] for i, k in enumerate(block.keys)]
                    keys, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    found = texts.select("lang", "text").mapInArrow(run, "key bigint, n bigint")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def sample_keys(texts: DataFrame, how: Phrases) -> DataFrame:
    """(key) of what the sample holds ``sample_least`` times, one word shorter than the longest at most."""
    some = texts.where(F.pmod(F.xxhash64(F.lit(20240311), "doc_id", "text"), F.lit(how.sample_one_in)) == 0)
    return key_counts(some, how.longest - 1, Block.new).where(F.col("n") >= how.sample_least).select("key")


def counted(texts: DataFrame, how: Phrases, before: Keys | None, now: Keys) -> DataFrame:
    """(key, n, failed) of frequent phrases whose parts ``now`` holds and ``before`` did not; the first pass counts words too.

    One fails the border that ``now`` does not hold and that is short enough to have longer ones around it.
    """

    def chosen(block: Block, length: int) -> np.ndarray:
        if length == 1:
            return block.new(1) if before is None else np.zeros(len(block.keys[0]), bool)
        found = block.new(length) & now.parts(block, length)
        return found if before is None else found & ~before.parts(block, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            failed = ~now.holds(keys) & ((keys & np.uint64(7)) < how.longest)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(failed)], ["key", "n", "failed"])

    frequent = key_counts(texts, how.longest, chosen).where(F.col("n") >= how.least)
    return frequent.mapInArrow(run, "key bigint, n bigint, failed boolean")


def named(texts: DataFrame, how: Phrases, frequent: Keys) -> DataFrame:
    """(lang, words, phrase, n) of the phrases whose key is held, and each language's words as the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, seed, own in by_language(batch):
                for block in blocks(own, seed, how.longest):
                    yield batch_of(lang, 0, pa.array([""]), np.array([block.words]))
                    for length in range(1, len(block.keys) + 1):
                        keys = block.keys[length - 1]
                        at = np.flatnonzero(block.new(length) & frequent.holds(keys))
                        if len(at):
                            # Within one block of a megabyte a key names one phrase (one block in millions holds two that share one).
                            _, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                            yield batch_of(lang, length, block.phrases(at[first], length), n)

    found = texts.select("lang", "text").mapInArrow(run, "lang string, words int, phrase string, n bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def batch_of(lang: str, length: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang), size), pa.repeat(pa.scalar(length, pa.int32()), size), phrases, pa.array(n, pa.int64())],
        ["lang", "words", "phrase", "n"])


def frequent_phrases(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of up to ``longest`` words that a language holds ``least`` times.

    The empty phrase (words = 0) carries the number of all words of the language.
    """
    texts = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    proposed = materialise(sample_keys(texts, how), "proposed")
    before, now, frequent = None, Keys(proposed, how.filter_bits), None
    while True:
        # Bitmaps only grow, so each phrase is counted in one pass: the first that holds both its parts.
        passed = materialise(counted(texts, how, before, now), "counted")
        frequent = passed if frequent is None else frequent.union(passed)
        failed = passed.where("failed").select("key")
        if failed.isEmpty():
            break
        proposed = proposed.union(failed)
        before, now = now, Keys(proposed, how.filter_bits)
    found = named(texts, how, Keys(frequent, how.filter_bits)).where((F.col("words") == 0) | (F.col("n") >= how.least))
    return materialise(found, "frequent").where((F.col("words") > 0) | (F.col("n") > 0))


def score_of(whole: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (l + r)) in decimals, as the product may pass 64 bits."""
    wide = "decimal(38,0)"
    return F.call_function("div", (whole.cast("decimal(28,0)") * F.lit(2_000_000).cast("decimal(9,0)")).cast(wide),
                           (left.cast("decimal(28,0)") + right.cast("decimal(28,0)")).cast(wide))


def scored(found: DataFrame, how: Phrases) -> DataFrame:
    """Candidates (lang, phrase, words, a) with l, r and score of their lowest-scoring cut."""
    parts = found.where((F.col("words") > 0) & (F.col("words") < how.longest)).select(
        F.struct("lang", "phrase").alias("part"), F.col("n").alias("_f"))
    split = F.split("phrase", " ")
    cuts = (
        found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), split.alias("_w"))
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    )
    sides = [("l", F.slice("_w", 1, F.col("cut"))), ("r", F.slice("_w", F.col("cut") + 1, F.col("words") - F.col("cut")))]
    for name, side in sides:
        cuts = cuts.withColumn("part", F.struct("lang", F.array_join(side, " ").alias("phrase")))
        # How often each part is asked for, so that a word which starts a third of all phrases is spread.
        asked = parts.join(cuts.groupBy("part").agg(F.count("*").alias("_n")), "part")
        cuts = salted_join(cuts, asked, "part", F.xxhash64("phrase", "cut")).withColumnRenamed("_f", name).drop("_n", "part")
        cuts = materialise(cuts, f"cuts-{name}")
    cuts = cuts.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r")))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("_best")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best).select(
        "lang", "phrase", "words", "a", "_best.l", "_best.r", "_best.score")


def covered(found: DataFrame, how: Phrases) -> DataFrame:
    """(lang, phrase, _longer): the largest count of a longer candidate around each phrase."""
    size, words_ = F.col("_size"), F.split("phrase", " ")
    inner = (
        found.where("words > 2").select("lang", "words", words_.alias("_w"), "n")
        .withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("words") - size + 1)))
    )
    return inner.select("lang", F.array_join(F.slice("_w", F.col("_at"), size), " ").alias("phrase"), "n").groupBy(
        "lang", "phrase").agg(F.max("n").alias("_longer"))


def phrases(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """The collocations of ``docs`` (doc_id, text, lang): lang, rank, phrase, a, l, r, n, score; other columns play no part.

    A null text is empty, a null lang ``und``; a language without candidates, an empty table too, gives no row.  Equal
    rows count as often as they come.  Phrases of equal score and count are ordered by their UTF-8 bytes.
    """
    found = frequent_phrases(docs, how)
    totals = found.where("words = 0").select("lang", F.col("n"))
    left = scored(found, how).join(covered(found, how), ["lang", "phrase"], "left").where(
        F.coalesce(F.lit(100) * F.col("_longer") < F.lit(how.inside) * F.col("a"), F.lit(True)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First the best of each of a fixed number of parts, so that no task sorts a whole language.
    part = Window.partitionBy("lang", "_salt").orderBy(*order)
    near = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))).withColumn(
        "_rank", F.row_number().over(part)).where(F.col("_rank") <= how.top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= how.top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
