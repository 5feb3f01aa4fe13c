import math

import pytest
from pyspark.sql import functions as F

from recordloom.llm import vector_search
from recordloom.llm.vector_search import top_k


def expected(rows, every, k):
    vectors = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in rows
               if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out, queries = [], {}
    for i, v in vectors:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def check(rows, every=50, k=5):
    assert sorted(map(tuple, top_k(rows, every, k).collect())) == expected(rows.collect(), every, k)


def test_equals_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))


def test_ties_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(100)] + [(100, None), (101, [None, 1.0, 1.0]), (102, [math.nan, 0.0, 0.0]),
            (103, [math.inf, 0.0, 0.0]), (104, [3.0, -9.0, 2.0]), (None, [1.0, 1.0, 1.0]), (105, [0.1, 0.2, 0.3]), (105, [0.1, 0.2, 0.3]),
            (110, [-0.5, 0.001, 0.2]), (110, [-0.5, 0.001, 0.2])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    check(table, 10)
    check(table.where("vec_id in (0, 50)"), 50)
    check(table.where("vec_id = 50"), 50)
    check(table.where("false"), 50)


@pytest.mark.parametrize("cells", [2, 16])
def test_coarse_cells_only_cost_reads(spark, monkeypatch, cells):
    monkeypatch.setattr(vector_search, "CELLS", cells)
    check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))


def test_repeated_ids_count_as_rows(spark):
    """As the SQL counterpart: an id may have one vector many times, or several vectors."""
    schema = "vec_id bigint, embedding array<double>"
    check(spark.createDataFrame([(0, [0.5, 0.25])] * 6 + [(1, [0.5, 0.25])], schema))
    check(spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.5, 0.0]), (8, [0.9, 0.0])], schema))
    check(spark.createDataFrame([(i % 4, [0.5, 0.25 * (i % 3)]) for i in range(90)] + [(9, [0.5]), (9, [0.5, 0.0, 0.0])], schema), 2)


def test_large_components(spark):
    """Bounds beyond 2**53 stay bounds; a score beyond 64 bits is an error."""
    rows = [(i, [float(3e4 * (i % 7 + 1)), -2e4 * (i % 5), 1e4 + i]) for i in range(60)]
    check(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 10)
    with pytest.raises(Exception, match="OVERFLOW"):
        top_k(spark.createDataFrame([(0, [1e16] * 3), (1, [1e16] * 3)], "vec_id bigint, embedding array<double>")).collect()
