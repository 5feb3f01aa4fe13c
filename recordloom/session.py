"""Session settings and the one way this package cuts lineage: a table in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
RUN_DIR = "recordloom.run.dir"


def local_session(cores: int | str = "*", memory: str = "20g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recordloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (tests, one machine) a fresh temporary folder is chosen and
    remembered in the session, so that one session uses one folder.
    """
    chosen = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("recordloom.shared.dir", None)
    if not chosen:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        chosen = tempfile.mkdtemp(prefix="recordloom-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("recordloom.shared.dir", chosen)
    return chosen


def new_folder(spark: SparkSession, label: str) -> str:
    parent = spark.conf.get(RUN_DIR, None) or shared_folder(spark)
    return f"{parent.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def empty_folder(spark: SparkSession, path: str) -> None:
    """Remove all tables below ``path``, wherever it lies: an empty table written over it takes their place."""
    spark.createDataFrame([], "nothing int").write.mode("overwrite").parquet(path)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Tables that cut lineage go to a folder of this run's own, which is emptied at the end.

    What is to outlive the run is written inside the scope; results that are read later must not depend on it.
    """
    outer = spark.conf.get(RUN_DIR, None)
    path = new_folder(spark, "run")
    spark.conf.set(RUN_DIR, path)
    try:
        yield path
    finally:
        spark.conf.set(RUN_DIR, outer) if outer else spark.conf.unset(RUN_DIR)
        empty_folder(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts lineage in a way that survives the loss of executors, and pins values that must not be
    computed twice (partition numbers, positions).
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
