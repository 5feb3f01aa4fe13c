"""JSON: an array of objects, one object per line, or an object of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_records(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Read records; plain values become text ('' when missing), nested values keep their type.

    An object of columns, {"name": {"0": ..}, "email": {"0": ..}}, is read as maps, so its row numbers never become
    fields of a schema; its nested values stay JSON text.
    """
    if multi_line:
        columns = _object_of_columns(spark, paths)
        if columns is not None:
            return _as_text(columns)
    return _as_text(spark.read.option("multiLine", multi_line).option("primitivesAsString", True).json(paths))


def _as_text(raw: DataFrame) -> DataFrame:
    return raw.select(
        *[
            F.trim(F.when(F.col(f"`{f.name}`").isNull() | F.col(f"`{f.name}`").isin("nan", "None"), "")
                   .otherwise(F.col(f"`{f.name}`"))).alias(f.name.strip())
            if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").alias(f.name.strip())
            for f in raw.schema.fields
        ]
    )


def _object_of_columns(spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    """The rows of files that hold an object of columns each, in order of their numbers; None if one holds anything else."""
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", "^\ufeff", "").alias("_text"))
    # Records in an array, and one record a line, are told by their beginning; nothing of them is parsed here.
    opened = F.col("_text").rlike(r'^\s*\{\s*"(?:[^"\\]|\\.)*+"\s*:\s*\{')
    parsed = files.select("_file", F.when(opened, F.from_json("_text", "map<string,map<string,string>>")).alias("_columns"))
    fits = F.col("_columns").isNotNull() & F.forall(F.map_values("_columns"), lambda rows: F.coalesce(
        (F.size(rows) > 0) & F.forall(F.map_keys(rows), lambda k: k.rlike("^[0-9]+$")), F.lit(False)))
    judged = parsed.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce(fits, F.lit(False))), F.lit(False)).alias("all")).first()
    if not judged["n"] or not judged["all"]:
        return None
    cells = parsed.select("_file", F.explode("_columns").alias("_name", "_rows")).select(
        "_file", "_name", F.posexplode("_rows").alias("_at", "_row", "_value"))
    # As many rows as there are columns, the way a header is read.
    names = [r["_name"] for r in cells.groupBy("_name").agg(F.count("*").alias("n")).orderBy("_name").collect()]
    # In the files' own order of columns, the first file's first.
    order = parsed.orderBy("_file").select(F.map_keys("_columns").alias("k")).first()["k"]
    names = [*[n for n in order if n in set(names)], *[n for n in names if n not in set(order)]]
    rows = cells.groupBy("_file", "_row").agg(*[
        F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(f"_c{i}") for i, n in enumerate(names)])
    placed = rows.orderBy("_file", F.length("_row"), "_row")
    return placed.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
