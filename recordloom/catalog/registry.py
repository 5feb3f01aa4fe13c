"""Every operator as a query over the given tables, with its SQL reading where there is one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from recordloom.catalog import sql as q
from recordloom.config import Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SETTINGS = Settings(as_of=datetime.fromisoformat(q.AS_OF).replace(tzinfo=timezone.utc))


def query(key: str, oracle: str | None = None):
    def add(function):
        QUERIES[key] = function
        if oracle:
            ORACLES[key] = oracle
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Dates are read as UTC whatever the machine's zone is.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def base(spark: SparkSession, folder: str, text: str, *tables: str) -> DataFrame:
    """A base table from its shared SQL text."""
    for name in tables:
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(text)


# Rows of a base table whose cleaning is one task's work; small tables are cut finer, down to LEAST_ROWS, to use all cores.
PIECE_ROWS, LEAST_ROWS = 20_000, 2_000


def spread(df: DataFrame) -> DataFrame:
    """The rows of ``df`` dealt evenly over as many partitions as their number asks for.

    A table that lies in one row group is read by one task; what is derived from it must not stay there.
    """
    rows = df.count()  # answered from the footers of the files
    pieces = max(-(-rows // PIECE_ROWS), min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))
    return df.repartition(pieces) if pieces > 1 else df


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    spread(table(spark, folder, "customer").select("c_custkey", "c_nationkey")).createOrReplaceTempView("customer")
    table(spark, folder, "nation").createOrReplaceTempView("nation")
    return spark.sql(q.DIRTY)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, q.HEADERS, "customer")


def grid(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, q.grid(True), "lineitem")
