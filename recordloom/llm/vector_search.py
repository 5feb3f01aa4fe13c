"""Exact top-k search by inner product over vector-approximation files.

Every vector is stored twice: as one byte per component, the cell of an even grid over all components, and exactly.
A scan of the cells alone bounds each score from below and above; per query the k-th largest lower bound is a score
that is surely reached.  Candidates whose upper bound lies under it are out.  The rest are read exactly, the most
promising first: once the k-th exact score is known, only candidates whose upper bound still reaches it are read.
Queries are taken in blocks of bounded size, each against all cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import materialise

CELLS = 64
QUERY_BLOCK = 2_048
SCAN_ROWS = 1_024
SALTS = 64


def integer_vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(vec_id, v): components as floor(256 * x), shorter vectors filled up with 0; unusable ones are left out."""
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col(ident).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("_x")).where(
        F.col("vec_id").isNotNull() & F.col("_x").isNotNull()).where(finite)
    return usable.select("vec_id", F.transform("_x", lambda x: F.floor(x * 256).cast("bigint")).alias("v"))


def fewest_rows(vectors: DataFrame, k: int) -> DataFrame:
    """(_row, vec_id, v): of equal vectors the rows of the k + 1 smallest ids, and at most k of each id.

    Equal vectors have equal scores and ties go to smaller ids; a query leaves the rows of one id out, so no other row can be
    among its best k.  Repeated rows are counted first and ids ranked in two steps, so that a common vector is no hot task.
    ``_row`` names a row, as an id may have several vectors.
    """
    held = vectors.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_copies"))
    held = held.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for keys in (["v", "_salt"], ["v"]):
        order = Window.partitionBy(*keys).orderBy("vec_id")
        held = held.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1).drop("_at")
    copies = held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "v")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def scan(cells: DataFrame, queries: list, low: int, width: int, k: int) -> DataFrame:
    """(query_id, _row, vec_id, lower, upper) for all rows of a partition that may be among a query's best k."""
    ids = np.array([q["vec_id"] for q in queries], np.int64)
    vectors = np.array([q["v"] for q in queries], np.float64)
    plus, minus = np.maximum(vectors, 0).T, np.minimum(vectors, 0).T
    # Sums of doubles are exact up to 2**53; beyond, bounds give way by more than they can be wrong.
    largest = max(abs(low), abs(low + width * CELLS)) * float(np.abs(vectors).sum(axis=1).max())
    slack = np.ceil(largest * 2.0**-45) if largest >= 2.0**53 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.full((len(ids), k), -np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            numbers, names = batch.column("vec_id").to_numpy(), batch.column("_row").to_numpy()
            packed = batch.column("cells").to_pylist()
            for at in range(0, len(numbers), SCAN_ROWS):
                mine, rows = numbers[at: at + SCAN_ROWS], names[at: at + SCAN_ROWS]
                grid = np.frombuffer(b"".join(packed[at: at + SCAN_ROWS]), np.uint8).reshape(len(mine), -1)
                floor = low + grid.astype(np.float64) * width
                ceiling = floor + (width - 1)
                lower = (floor @ plus + ceiling @ minus).T - slack
                upper = (ceiling @ plus + floor @ minus).T + slack
                own = ids[:, None] == mine[None, :]
                lower[own], upper[own] = -np.inf, -np.inf
                both = np.concatenate([reached, lower], axis=1)
                reached = -np.partition(-both, k - 1, axis=1)[:, :k]
                sure = reached.min(axis=1)
                q, v = np.nonzero((upper >= sure[:, None]) & ~own)
                found.append((q, rows[v], mine[v], lower[q, v], upper[q, v]))
        if not found:
            return
        q, rows, v, lower, upper = (np.concatenate(part) for part in zip(*found))
        stay = upper >= reached.min(axis=1)[q]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[q[stay]]), pa.array(rows[stay]), pa.array(v[stay]), pa.array(lower[stay]), pa.array(upper[stay])],
            ["query_id", "_row", "vec_id", "lower", "upper"])

    return cells.select("_row", "vec_id", "cells").mapInArrow(
        run, "query_id bigint, _row bigint, vec_id bigint, lower double, upper double")


def encoded(vectors: DataFrame, low: int, width: int) -> DataFrame:
    """Add ``cells``: one byte per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = batch.column("v")
            codes = [((np.array(v, np.int64) - low) // width).astype(np.uint8).tobytes() for v in exact.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("vec_id"), exact, pa.array(codes, pa.binary())],
                                             ["_row", "vec_id", "v", "cells"])

    return vectors.mapInArrow(run, "_row bigint, vec_id bigint, v array<bigint>, cells binary")


def top_k(rows: DataFrame, every: int = 50, k: int = 5, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k best other rows.

    Vectors that are null or hold null or non-finite components take no part.  Ties go to the smaller vec_id.  A
    repeated id is one query (its smallest vector) and as many candidates as it has rows; none of them is a candidate
    of its own query.  Vectors of different length are compared as if the shorter one ended in zeros.  Scores are 64-bit
    integers; components so large that a score leaves them are an error of Spark's, ARITHMETIC_OVERFLOW or CAST_OVERFLOW.
    """
    vectors = materialise(integer_vectors(rows, ident, vector), "vectors")
    length, low, high = vectors.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    nothing = rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not length:
        return nothing
    low, high = min(low, 0), max(high, 0)
    full = vectors.select("vec_id", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), length - F.size("v"))).alias("v"))
    width = -(-(high - low + 1) // CELLS)
    queries = full.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialise(queries, "queries")
    held = queries.count()
    if not held:
        return nothing
    stored = materialise(encoded(fewest_rows(full, k), low, width), "cells")
    blocks = -(-held // QUERY_BLOCK)
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))
    candidates = None
    for number in range(blocks):
        # The driver holds about QUERY_BLOCK vectors at a time; what they found is written before the next are read.
        part = queries.where(block == number).collect()
        if part:
            some = materialise(scan(stored, part, low, width, k), "candidates")
            candidates = some if candidates is None else candidates.unionByName(some)

    by_query = Window.partitionBy("query_id")
    sure = candidates.withColumn("_at", F.row_number().over(by_query.orderBy(F.desc("lower")))).where(
        F.col("_at") <= k).groupBy("query_id").agg(F.min("lower").alias("_sure"), F.count("*").alias("_held"))
    open_ = candidates.join(sure, "query_id").where((F.col("upper") >= F.col("_sure")) | (F.col("_held") < k))
    open_ = open_.withColumn("_turn", F.row_number().over(by_query.orderBy(F.desc("upper"), "vec_id", "_row")))
    exact = stored.select("_row", "v")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("_q"))

    def read(some: DataFrame) -> DataFrame:
        return some.join(exact, "_row").join(asked, "query_id").select("query_id", "vec_id", dot("v", "_q").alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = materialise(read(open_.where(F.col("_turn") <= 2 * k)), "first-read")
    kth = first.withColumn("_at", F.row_number().over(best)).where(F.col("_at") == k).select("query_id", F.col("score").alias("_kth"))
    rest = open_.where(F.col("_turn") > 2 * k).join(kth, "query_id", "left").where(
        F.col("_kth").isNull() | (F.col("upper") >= F.col("_kth")))
    return first.unionByName(read(rest)).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
