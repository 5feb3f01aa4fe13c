"""What the corpus operators share: words, row identity, a bounded row filter, and ranks without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.session import empty_folder, new_folder

# Words are runs of anything but ASCII white space; bytes.split() of Python cuts at the same six characters.
BREAKS = r"[\x20\x09-\x0D]+"
BITMAP_WORDS = 1 << 16
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20
BROADCAST_ROWS = 20_000
SALTS = 64


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def n_words(text: Column) -> Column:
    """How many words a text has (null: 0), without building an array of them."""
    one_each = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(one_each, BREAKS, "")).cast("bigint")


def row_key(seed: int, *columns: str) -> Column:
    """64 bits that name a row by its values; nulls count as values."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *parts)


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cut ``rows`` in those that may have a ``key`` in ``keys`` and those that surely have none.

    The keys are folded into a bitmap of BITMAP_WORDS * 64 bits, at most BITMAP_WORDS rows whatever the input,
    so it may be broadcast.  A full bitmap only sends more rows the long way.
    """
    slot = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(BITMAP_WORDS * 64))
    words = (
        keys.select(F.shiftright(slot, 6).alias("_word"), F.expr("cast(1 as bigint)").alias("_one"),
                    F.pmod(slot, F.lit(64)).cast("int").alias("_at"))
        .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _at)")).alias("_bits"))
    )
    marked = rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6)).join(
        F.broadcast(words), "_word", "left"
    )
    hit = F.expr("coalesce(shiftrightunsigned(_bits, cast(pmod(_slot, 64) as int)) & 1, 0) = 1")
    extra = ("_slot", "_word", "_bits")
    return marked.where(hit).drop(*extra), marked.where(~hit).drop(*extra)


def even_rank(rows: DataFrame, group: list[str], identity: Column, per_bucket: int, total: int, out: str) -> DataFrame:
    """Add ``out``: a gapless number from 0 inside each group.

    Rows are dealt over hash buckets of about ``per_bucket`` rows; each bucket is numbered alone and starts
    where the earlier ones of its group end.  Which row gets which number is decided by ``identity``; rows that
    agree in it are interchangeable.  The table of bucket sizes is small: total / per_bucket rows a group.
    """
    buckets = max(1, -(-total // per_bucket))
    dealt = rows.withColumn("_by", identity).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(11), "_by"), F.lit(buckets)))
    sizes = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_bucket").orderBy("_by")
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, [*group, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_at")).cast("bigint"))
        .drop("_by", "_bucket", "_at", "_start")
    )


def small_batches(spark: SparkSession) -> None:
    """Let whole texts reach Python in batches of BATCH_BYTES at most, or one row, for the rest of the session.

    The usual limits are 10,000 rows and 64 MB, and a batch is held by the JVM on its way there and back and by Python
    at the same time, once a task.  A limit that the session states itself stays.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")


def kept_as_table(rows: DataFrame, label: str) -> DataFrame:
    """Write ``rows`` to the shared folder, tightly compressed as texts and ids are large, and read them back."""
    path = new_folder(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Scratch:
    """Tables of a step that nobody reads once its result is written; ``clear`` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.held = spark, new_folder(spark, "scratch"), 0

    def keep(self, rows: DataFrame, label: str) -> DataFrame:
        self.held += 1
        path = f"{self.folder}/{label}-{self.held}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        empty_folder(self.spark, self.folder)


def join_figures(rows: DataFrame, figures: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join (null equals null) with a table of one row per ``key``.

    It is broadcast only after its rows were counted; a longer one is joined with each key spread over salts by
    ``spread``, so that a hot key is no hot task.  Both ways give the same rows.
    """
    figures = figures.withColumnRenamed(key, "_of")
    if figures.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(figures), rows[key].eqNullSafe(figures["_of"]), "left").drop("_of")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(13), spread), F.lit(SALTS)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    repeated = figures.withColumn("_salt_of", F.explode(every))
    return salted.join(repeated, salted[key].eqNullSafe(repeated["_of"]) & (F.col("_salt") == F.col("_salt_of")),
                       "left").drop("_of", "_salt", "_salt_of")
