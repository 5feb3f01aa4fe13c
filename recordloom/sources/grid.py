"""Workbook grids: (sheet_id, row_no, row_repeat, cells array<struct<text, repeat>>) to tables.

A sheet may hold any share of the rows, so nothing is ordered inside a window over a sheet; running
sums over range-partitioned data do that work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators.balance import salted_join
from recordloom.operators.ordering import dense_index, running_sum
from recordloom.session import materialise
from recordloom.sources.delimited import unique_names


def safe_repeat(value: Column, limit: int | None = None) -> Column:
    """Repeat counts: unreadable or below one -> 1, above a given limit -> the limit."""
    n = F.coalesce(value.cast("string").try_cast("int"), F.lit(1))
    if limit is None or limit > 0:  # reads the value once
        return F.greatest(F.lit(1), n if limit is None else F.least(n, F.lit(limit))).cast("int")
    return F.when(n <= 0, 1).otherwise(F.least(n, F.lit(limit))).cast("int")


def expand_cells(cells: Column, limit: int | None = None) -> Column:
    return F.flatten(
        F.transform(cells, lambda c: F.array_repeat(F.coalesce(c["text"], F.lit("")), safe_repeat(c["repeat"], limit)))
    )


def trim_trailing(cells: Column) -> Column:
    """Cells up to the last non-empty one."""
    used = F.array_max(F.transform(cells, lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    return F.slice(cells, F.lit(1), F.coalesce(used, F.lit(0)))


def expand_repeats(grid: DataFrame, limit: int | None = None) -> DataFrame:
    """Repeated cells and rows written out: (sheet_id, row_no, copy_no, cells)."""
    wide = grid.select("sheet_id", "row_no", expand_cells(F.col("cells"), limit).alias("cells"),
                       safe_repeat(F.col("row_repeat"), limit).alias("_n"))
    return wide.select(
        "sheet_id", "row_no", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"), "cells"
    )


def without_blank_tail(cells: Column) -> Column:
    """Entries up to the last filled one; sheets commonly end their rows with a blank repeated to the last column."""
    used = F.array_max(F.transform(cells, lambda c, i: F.when(F.coalesce(c["text"], F.lit("")) != "", i + 1).otherwise(0)))
    return F.slice(cells, F.lit(1), F.coalesce(used, F.lit(0)))


def normal_rows(grid: DataFrame, limit: int | None = None) -> DataFrame:
    """(sheet_id, row_no, repeat, cells): cells expanded and trimmed, repeats made safe.

    Trimming reads the expanded cells twice, so they are a column of their own before it.  An entry that is there once at least
    keeps its last place, so without its blank tail a row is trimmed already.
    """
    wide = grid.select(
        "sheet_id", "row_no", safe_repeat(F.col("row_repeat"), limit).alias("repeat"),
        expand_cells(without_blank_tail(F.col("cells")), limit).alias("cells"),
    )
    if limit is None or limit > 0:
        return wide
    return wide.select("sheet_id", "row_no", "repeat", trim_trailing(F.col("cells")).alias("cells"))


def before_end(marked: DataFrame, max_blank_run: int) -> DataFrame:
    """The filled rows (``_filled`` = 1) of each sheet before its first run of ``max_blank_run`` blank ones once data has begun.

    For that every row learns how many filled rows came before it.  Blanks with the same count form one run,
    and a run is summed before it is shuffled.  A sheet ends at the row where that run begins, so only numbers are put in
    order, whatever else the rows carry; ``marked`` is read more than once.
    """
    places = marked.select("sheet_id", "row_no", "repeat", "_filled")
    counted = running_sum(places, ["sheet_id"], ["row_no"], "_before", weight="_filled")
    runs = counted.where("_filled = 0 and _before > 0").groupBy("sheet_id", "_before").agg(
        F.sum("repeat").alias("_run"), F.min("row_no").alias("_end"))
    ends = runs.where(F.col("_run") >= max_blank_run).groupBy("sheet_id").agg(F.min("_end").alias("_end"))
    filled = marked.where("_filled = 1").drop("_filled")
    sizes = filled.groupBy("sheet_id").agg(F.count("*").alias("_n"))
    # Written once, so that its size is known before the join.
    sheets = materialise(sizes.join(ends, "sheet_id", "left"), "ends")
    kept = salted_join(filled, sheets, "sheet_id", F.col("row_no"))
    return kept.where(F.col("_end").isNull() | (F.col("row_no") < F.col("_end"))).drop("_n", "_end")


def drop_blank_rows(rows: DataFrame, max_blank_run: int | None = None) -> DataFrame:
    """Remove blank rows.  With ``max_blank_run`` a sheet ends at a run of that many once data has begun."""
    if max_blank_run is None:
        return rows.where(F.size("cells") > 0)
    marked = rows.withColumn("_filled", F.when(F.size("cells") > 0, 1).otherwise(0))
    return before_end(materialise(marked, "rows"), max_blank_run)


def counted_rows(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """(sheet_id, row_no, copies, cells): how often each row is written out, at most ``cap`` rows per sheet if given.

    Only numbers are put in order; the cells join those that have a place, at most ``cap`` rows per sheet.
    """
    if cap is None:
        return rows.select("sheet_id", "row_no", F.col("repeat").cast("bigint").alias("copies"), "cells")
    starts = running_sum(rows.select("sheet_id", "row_no", "repeat"), ["sheet_id"], ["row_no"], "_start", weight="repeat")
    starts = materialise(starts.where(F.col("_start") < cap).select("sheet_id", "row_no", "_start"), "starts")
    copies = F.least(F.col("repeat").cast("bigint"), F.lit(cap) - F.col("_start"))
    return rows.join(starts, ["sheet_id", "row_no"]).select("sheet_id", "row_no", copies.alias("copies"), "cells")


def cap_rows(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """Write row repeats out, at most ``cap`` rows per sheet if given: (sheet_id, row_no, copy_no, cells)."""
    return counted_rows(rows, cap).select(
        "sheet_id", "row_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy_no"), "cells"
    )


def cut_report(grid: DataFrame, repeat: int | None, blank_run: int | None, cap: int | None) -> DataFrame:
    """(sheet_id, rows, kept): filled rows of each sheet without and with the given limits.

    Cells are looked at once, for whether any holds text; none is written out.
    """
    text = F.exists("cells", lambda c: F.coalesce(c["text"], F.lit("")) != "")
    filled = text if repeat is None or repeat > 0 else F.lit(False)  # no copy of a cell holds none of its text
    marked = materialise(grid.select(
        "sheet_id", "row_no", safe_repeat(F.col("row_repeat")).alias("_whole"), safe_repeat(F.col("row_repeat"), repeat).alias("repeat"),
        text.alias("_text"), F.when(filled, 1).otherwise(0).alias("_filled")), "marked")
    whole = marked.where("_text").groupBy("sheet_id").agg(F.sum(F.col("_whole").cast("bigint")).alias("rows"))
    left = marked.where("_filled = 1") if blank_run is None else before_end(marked, blank_run)
    left = left.groupBy("sheet_id").agg(F.sum(F.col("repeat").cast("bigint")).alias("kept"))
    kept = F.coalesce("kept", F.lit(0))
    return whole.join(left, "sheet_id", "left").select(
        "sheet_id", "rows", (kept if cap is None else F.least(kept, F.lit(cap))).cast("bigint").alias("kept"))


def padded(cells: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.col("_width") - F.size(cells)))


def header_rows(rows: DataFrame) -> DataFrame:
    """(sheet_id, _n, _width, _first, _headers): rows and width of each sheet, place and cells of its first row."""
    order = F.struct("row_no", "copy_no")
    return rows.groupBy("sheet_id").agg(
        F.count("*").alias("_n"), F.max(F.size("cells")).alias("_width"),
        F.min(order).alias("_first"), F.min_by("cells", order).alias("_headers"),
    )


def counted_headers(rows: DataFrame) -> DataFrame:
    """(sheet_id, _n, _width, _first, _headers) of rows that are not written out: ``_first`` is the ``row_no`` of the first one.

    The sums hold numbers only; the cells of a first row meet them afterwards.
    """
    sheets = materialise(rows.groupBy("sheet_id").agg(
        F.sum("copies").alias("_n"), F.max(F.size("cells")).alias("_width"), F.min("row_no").alias("_first")), "sizes")
    firsts = sheets.select("sheet_id", F.col("_first").alias("row_no"))
    heads = rows.join(firsts, ["sheet_id", "row_no"]).select("sheet_id", F.col("cells").alias("_headers"))
    return sheets.join(heads.dropDuplicates(["sheet_id"]), "sheet_id")


def below_header(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows below the first of each sheet, with what ``sheets`` says of it."""
    joined = salted_join(rows, sheets, "sheet_id", F.xxhash64("row_no", "copy_no"))
    return joined.where(F.struct("row_no", "copy_no") != F.col("_first"))


def headed(rows: DataFrame) -> DataFrame:
    """Rows below the first of each sheet, with that row (``_headers``) and the width of the sheet (``_width``).

    What is known of the sheets is written once; the join reads it several times.
    """
    return below_header(rows, materialise(header_rows(rows), "sheets"))


def promote_header(rows: DataFrame) -> DataFrame:
    """First row of each sheet = headers: (sheet_id, row_no, copy_no, position, header, value).

    Rows are padded to the widest row of the sheet.
    """
    body = headed(rows)
    cells = F.arrays_zip(
        F.transform(padded(F.col("_headers")), lambda h: tx.strip(h)).alias("header"),
        padded(F.col("cells")).alias("value"),
    )
    return body.select("sheet_id", "row_no", "copy_no", F.posexplode(cells).alias("position", "_cell")).select(
        "sheet_id", "row_no", "copy_no", "position", F.col("_cell.header").alias("header"), tx.strip(F.col("_cell.value")).alias("value")
    )


def read_grid(grid: DataFrame, repeat: int | None = None, blank_run: int | None = None, cap: int | None = None) -> DataFrame:
    """The whole way from a grid to cells with headers.  Nothing is cut unless a limit is given; see ``cut_report``."""
    return promote_header(cap_rows(drop_blank_rows(normal_rows(grid, repeat), blank_run), cap))


def grid_table(grid: DataFrame, repeat: int | None = None, blank_run: int | None = None, cap: int | None = None) -> DataFrame:
    """The rows of all sheets as one table of text columns: sheet_id, row_no, copy_no and a column for every header.

    Sheets with the same headers are one layout; only the layouts reach the driver, to name the columns (repeated headers get
    .1, .2, ..., empty ones their position).  Cells are taken by position, nothing is pivoted.  A column that a sheet lacks is
    null, a cell that a row lacks empty.

    The grid is read once: its normal rows are written, what is known of the sheets comes from numbers alone, and a cell is stripped once,
    however many columns there are and however often its row is repeated.
    """
    rows = counted_rows(drop_blank_rows(materialise(normal_rows(grid, repeat), "normal"), blank_run), cap)
    sheets = materialise(counted_headers(rows).withColumn("_layout", F.transform(padded(F.col("_headers")), lambda h: tx.strip(h))), "sheets")
    layouts = [row["_layout"] for row in sheets.where("_n > 1").select("_layout").distinct().orderBy("_layout").collect()]
    if not layouts:
        return grid.select("sheet_id", "row_no", F.lit(1).cast("bigint").alias("copy_no")).where("false")
    named = [unique_names(layout) for layout in layouts]
    # Names that differ in case alone are one column, unless a sheet holds both.
    alike = all(len({name.lower() for name in own}) == len(own) for own in named)
    fold = str.lower if alike else str
    names: dict[str, str] = {}
    for name in (name for own in named for name in own):
        names.setdefault(fold(name), name)
    # Each sheet brings the place of every column among its cells, so one pass writes all layouts.
    placed = [{fold(name): at for at, name in enumerate(own)} for own in named]
    places = [(layout, [at.get(name) for name in names]) for layout, at in zip(layouts, placed)]
    known = grid.sparkSession.createDataFrame(places, "_layout array<string>, _places array<int>")
    # Written too, so that its size is known before the join.
    sheets = materialise(sheets.join(known, "_layout").select("sheet_id", "_n", "_first", "_places"), "places")
    body = salted_join(rows, sheets, "sheet_id", F.xxhash64("row_no")).where(F.col("_places").isNotNull())
    is_first = F.col("row_no") == F.col("_first")
    texts = F.transform("cells", lambda c: tx.strip(F.when(c.isin("nan", "None"), "").otherwise(c)))
    body = body.where(~is_first | (F.col("copies") > 1)).select(
        "sheet_id", "row_no", F.sequence(F.when(is_first, 2).otherwise(1).cast("bigint"), F.col("copies")).alias("_copies"), texts.alias("_texts"), "_places")
    # Rows may be shorter than their sheet is wide.
    values = F.transform("_places", lambda at: F.when(at.isNotNull(), F.coalesce(F.get("_texts", at), F.lit(""))))
    body = body.select("sheet_id", "row_no", "_copies", values.alias("_values")).select(
        "sheet_id", "row_no", F.explode("_copies").alias("copy_no"), "_values")
    return body.select("sheet_id", "row_no", "copy_no", *[F.get("_values", F.lit(i)).alias(name) for i, name in enumerate(names.values())])


def grid_rows(grid: DataFrame, **limits: int | None) -> DataFrame:
    """What ``plans.run.run`` takes: the table of a grid with ``row_id`` in the order of sheets and rows."""
    table = grid_table(grid, **limits)
    return dense_index(table, ["sheet_id", "row_no", "copy_no"], "row_id").drop("sheet_id", "row_no", "copy_no")
