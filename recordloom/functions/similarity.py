"""Indel similarity: 100 * (1 - (insertions + deletions) / (length + length)).

Two forms with equal results: a pure JVM expression and an Arrow UDF that keeps the state of the
longest-common-subsequence recurrence in the bits of one integer.  The UDF is the fast one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score_from_lcs(common: Column, left: Column, right: Column) -> Column:
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        100.0 * (1.0 - (total - 2 * common).cast("double") / total)
    )


def indel_ratio_jvm(left: Column, right: Column) -> Column:
    """Row-by-row dynamic programme over the characters, in higher-order functions only."""
    letters = F.split(right, "")
    start = F.array_repeat(F.lit(0), F.length(right) + 1)

    def next_row(row, ch):
        def step(acc, i):
            value = F.greatest(
                F.element_at(acc, -1),
                F.element_at(row, i + 1),
                F.element_at(row, i) + F.when(F.element_at(letters, i) == ch, 1).otherwise(0),
            )
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(right)), F.array(F.lit(0)), step)

    table = F.aggregate(F.split(left, ""), start, next_row)
    lcs = F.when((F.length(left) == 0) | (F.length(right) == 0), 0).otherwise(F.element_at(table, -1))
    return score_from_lcs(lcs, left, right)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 100.0 * (1.0 - (total - 2 * common_length(a, b)) / total)


LANE = 64
AT_ONCE = 2_048


def _common_lengths(longer: np.ndarray, shorter: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``common_length`` of many pairs at once: rows of code points, the state of each pair in one 64-bit lane.

    ``longer`` has LANE columns at most, ``sizes`` the lengths of both; unused places are 0.
    """
    free = np.where(sizes[0] < LANE, (np.uint64(1) << np.minimum(sizes[0], LANE - 1).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    full = free.copy()
    width = -(-longer.shape[1] // 8)
    if longer.max(initial=0) < 256 and shorter.max(initial=0) < 256:
        longer, shorter = longer.astype(np.uint8), shorter.astype(np.uint8)
    packed = np.zeros((len(longer), LANE // 8), np.uint8)
    for at in range(int(sizes[1].max(initial=0))):
        packed[:, :width] = np.packbits(longer == shorter[:, at: at + 1], axis=1, bitorder="little")
        where = packed.view(np.uint64)[:, 0]
        hit = np.where(at < sizes[1], free & where, np.uint64(0))
        free = (free + hit) | (free - hit)
    return sizes[0] - np.bitwise_count(free & full).astype(np.int64)


def ratios(left: list, right: list) -> np.ndarray:
    """``ratio`` of many pairs; NaN where a side is None.  Texts beyond LANE letters, or with the sign 0, go one by one."""
    out = np.full(len(left), np.nan)
    sides = np.array([left, right], object).reshape(2, -1)
    known = np.flatnonzero(~pd.isna(sides).any(axis=0))
    sides = sides[:, known]
    sizes = np.array([[*map(len, side)] for side in sides], np.int64).reshape(2, -1)
    turned = sizes[0] < sizes[1]
    sides, sizes = np.where(turned, sides[::-1], sides), np.where(turned, sizes[::-1], sizes)
    # Pairs of similar length together, so that few steps are idle.
    order = np.argsort(sizes[1], kind="stable")
    alone = order[sizes[0][order] > LANE].tolist()
    order = order[sizes[0][order] <= LANE]
    for start in range(0, len(order), AT_ONCE):
        at = order[start: start + AT_ONCE]
        some, widths = sizes[:, at], np.maximum(sizes[:, at].max(axis=1), 1)
        grids = [side[at].astype(f"<U{n}").view(np.uint32).reshape(len(at), n) for side, n in zip(sides, widths)]
        common, total = _common_lengths(*grids, some), some.sum(axis=0)
        out[known[at]] = np.where(total == 0, 100.0, 100.0 * (1.0 - (total - 2 * common) / np.maximum(total, 1)))
        whole = [np.count_nonzero(grid, axis=1) == size for grid, size in zip(grids, some)]
        alone += at[~(whole[0] & whole[1])].tolist()
    for i in alone:
        out[known[i]] = ratio(sides[0, i], sides[1, i])
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    # A nullable series: NaN is null there.
    return pd.Series(pd.array(ratios(left.tolist(), right.tolist()), dtype="Float64"))


def field_similarity(left: Column, right: Column) -> Column:
    """0 when a side is empty, 100 when equal after trim and lower, otherwise the indel ratio."""
    return tidy_similarity(F.lower(F.trim(left)), F.lower(F.trim(right)))


def tidy_similarity(a: Column, b: Column) -> Column:
    """``field_similarity`` of texts that are trimmed and lower-case already; doing so again is most of the cost of a pair."""
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    undecided = F.coalesce(~empty & (a != b), F.lit(False))
    return (
        F.when(empty, 0.0)
        .when(a == b, 100.0)
        .otherwise(indel_ratio(F.when(undecided, a), F.when(undecided, b)))
    )


def equality_similarity(left: Column, right: Column) -> Column:
    a, b = F.trim(left.cast("string")), F.trim(right.cast("string"))
    return F.when(F.coalesce((a == b) & (a != ""), F.lit(False)), 100.0).otherwise(0.0)


class _Packed:
    """All aliases side by side in one integer, each followed by a guard bit that stops carries."""

    def __init__(self, aliases: list[str]):
        self.aliases = aliases
        self.spans, self.where, offset, guards = [], {}, 0, 0
        for alias in aliases:
            for i, ch in enumerate(alias):
                self.where[ch] = self.where.get(ch, 0) | (1 << (offset + i))
            self.spans.append((offset, len(alias)))
            offset += len(alias) + 1
            guards |= 1 << (offset - 1)
        self.keep = ((1 << offset) - 1) & ~guards
        self.places = {alias: place for place, alias in reversed(list(enumerate(aliases)))}
        self.seen: dict[str, tuple[int, float] | None] = {}

    def best(self, text: str) -> tuple[int, float] | None:
        """(position, score) of the best alias; the first one wins a tie."""
        if text in self.places:
            return self.places[text], 100.0
        found = self.seen.get(text, False)
        if found is not False:
            return found
        free = self.keep
        for ch in text:
            hit = free & self.where.get(ch, 0)
            free = ((free + hit) | (free - hit)) & self.keep
        best = None
        for position, (offset, size) in enumerate(self.spans):
            total = size + len(text)
            lcs = size - ((free >> offset) & ((1 << size) - 1)).bit_count()
            score = 100.0 * (1.0 - (total - 2 * lcs) / total) if total else 100.0
            if best is None or score > best[1]:
                best = (position, score)
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[text] = best
        return best


def best_alias(values: Column, aliases: list[str]) -> Column:
    """struct(position, score) of the alias nearest to each value; null for null values.

    ``aliases`` is a list of the driver and travels with the function.
    """
    held: list[_Packed] = []

    @F.pandas_udf("position int, score double")
    def find(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(_Packed(aliases))
        hits = [None if t is None else held[0].best(t) for t in texts]
        return pd.DataFrame(
            {
                "position": pd.array([None if h is None else h[0] for h in hits], dtype="Int32"),
                "score": pd.array([None if h is None else h[1] for h in hits], dtype="Float64"),
            }
        )

    return find(values)


def near_value(values: Column, lookup: dict[str, str], threshold: float) -> Column:
    """For every text the value of its nearest key, null below the threshold and for null."""
    held: list[_Packed] = []
    chosen = list(lookup.values())

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(_Packed(list(lookup)))
        hits = (None if t is None else held[0].best(t) for t in texts)
        return pd.Series([chosen[h[0]] if h and h[1] >= threshold else None for h in hits], dtype=object)

    return find(values)


def near_values(lists: Column, lookup: dict[str, str], threshold: float) -> Column:
    """For every element of an array the value of its nearest key, null below the threshold."""
    held: list[_Packed] = []
    values = list(lookup.values())

    @F.pandas_udf("array<string>")
    def find(rows: pd.Series) -> pd.Series:
        if not held:
            held.append(_Packed(list(lookup)))

        def one(text):
            hit = None if text is None else held[0].best(text)
            return values[hit[0]] if hit and hit[1] >= threshold else None

        return rows.map(lambda row: None if row is None else [one(t) for t in row])

    return find(lists)
