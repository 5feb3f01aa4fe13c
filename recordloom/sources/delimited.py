"""Delimited text: every column a string, the best of several encodings, headers as written."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.session import materialise

ENCODINGS = ["utf-8", "cp1252", "latin-1"]


def header_quality(headers: Column) -> Column:
    """100 per column, minus 500 per replacement character, minus 20 per question mark."""
    def count(text: Column, char: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))

    score = F.aggregate(
        headers, F.lit(0), lambda acc, h: acc + 100 - 500 * count(h, "\ufffd") - 20 * count(h, "?")
    )
    return F.when(F.size(headers) == 0, -10_000).otherwise(score)


def from_cp1252(latin1: Column) -> Column:
    """Bytes 80-9F read as Latin-1 -> the characters Windows code page 1252 gives them."""
    raw = "".join(chr(b) for b in fv.CP1252_BYTES)
    return F.translate(latin1, raw, bytes(fv.CP1252_BYTES).decode("cp1252"))


def header_fields(line: Column, separator: str = ",") -> Column:
    """Fields of a header line, quotes removed, trimmed."""
    s = "\\" + separator
    parts = F.split(line, rf'{s}(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda p: F.trim(F.replace(F.regexp_replace(F.trim(p), r'^"|"$', ""), F.lit('""'), F.lit('"'))))


def _after_quotes(text: Column, separator: str, started_open: bool = False) -> Column:
    """Struct (state, fields) after a line's last quote: state 1 says that a quoted cell is still open.

    A quote opens a cell only where one starts, in a cell the next quote closes it, and two in a row are a quote in it; any other is an
    ordinary character (state 0; 2: just closed; 3: nothing read yet).  ``fields`` counts separators outside quotes.
    """
    pieces = F.split(text, '"', -1)
    separators = lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit(separator), F.lit("")))

    def step(done: Column, piece: Column) -> Column:
        state = done["state"]
        starts = piece.endswith(separator) | ((piece == "") & (state >= 2))
        return F.struct(F.when(state == 1, 2).when(starts, 1).otherwise(0).alias("state"),
                        (done["fields"] + F.when(state == 1, 0).otherwise(separators(piece))).alias("fields"))

    start = F.struct(F.lit(1 if started_open else 3).alias("state"), F.lit(0).alias("fields"))
    done = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step)
    last = F.when(done["state"] == 1, 0).otherwise(separators(F.element_at(pieces, -1)))
    return F.struct(done["state"].alias("state"), (done["fields"] + last + 1).alias("fields"))


def _left_open(text: Column, separator: str) -> Column:
    """Whether a quoted cell of a record that starts with this line goes on in the next."""
    return F.when(text.contains('"'), _after_quotes(text, separator)["state"] == 1).otherwise(False)


def inspect_files(spark: SparkSession, paths: str | list[str], separator: str = ",") -> DataFrame:
    """One row per file: path, encoding, score, headers, splittable, header_open, header_block.

    One parallel pass over the lines.  A line is kept as its raw bytes; a file qualifies for an
    encoding only if all of its lines do.  ``splittable`` says that no quoted cell spans lines, so
    that each line is a record.  Blank lines are no header; ``header_open`` says that the first
    line that isn't blank ends inside a quoted header, ``header_block`` in which block of the file it stands.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"),
        "value",
        F.is_valid_utf8("value").alias("utf8"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("latin"),
    )
    unused = "[" + "".join(f"\\x{b:02X}" for b in fv.CP1252_UNUSED) + "]"
    filled = F.regexp_replace("latin", "[\r\n\uFEFF]|^ï»¿", "") != ""
    lines = lines.withColumn("open", _left_open(F.regexp_replace("latin", "^ï»¿", ""), separator))
    files = lines.groupBy("path").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_and(~F.col("latin").rlike(unused)).alias("cp1252"),
        F.bool_and(~F.col("open")).alias("splittable"),
        # Without any text the file has no header.
        F.min_by(F.struct("value", "latin", "open", "at.block"), F.when(filled, F.col("at"))).alias("first"),
    )
    # A byte order mark is not part of the first header.
    utf8 = F.regexp_replace("first.value", "^\ufeff", "")
    candidates = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("utf-8").alias("encoding"), F.when(F.col("utf8"), utf8).alias("line")),
        F.struct(F.lit(1).alias("ord"), F.lit("cp1252").alias("encoding"),
                 F.when(F.col("cp1252"), from_cp1252(F.col("first.latin"))).alias("line")),
        F.struct(F.lit(2).alias("ord"), F.lit("latin-1").alias("encoding"), F.col("first.latin").alias("line")),
    )
    tried = files.select("path", "splittable", "first.open", "first.block", F.explode(candidates).alias("c")).where("c.line is not null").select(
        "path", "splittable", F.col("open").alias("header_open"), F.col("block").alias("header_block"), "c.ord", "c.encoding",
        header_fields(F.col("c.line"), separator).alias("headers")
    )
    return pick_encoding(tried.withColumn("score", header_quality(F.col("headers"))))


def pick_encoding(tried: DataFrame) -> DataFrame:
    """(path, ord, encoding, headers, score, ...) -> the best candidate of each path.

    A later candidate replaces an earlier one only with a strictly higher score, and nothing after a
    score of 1000 is looked at; so the first at 1000 or more wins, else the first of the best.
    """
    enough = F.col("score") >= 1000
    best = F.struct(enough.alias("enough"), F.when(enough, 0).otherwise(F.col("score")).alias("s"), (-F.col("ord")).alias("o"))
    return tried.groupBy("path").agg(
        F.max_by(F.struct(*[c for c in tried.columns if c not in ("path", "ord")]), best).alias("b")
    ).select("path", "b.*")


def unique_names(headers: list[str]) -> list[str]:
    """Repeated headers get .1, .2, ...; empty ones are named by position."""
    seen: dict[str, int] = {}
    names = []
    for i, header in enumerate(headers):
        name = header or f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(name if count == 0 else f"{name}.{count}")
    return names


def stringify_cells(df: DataFrame) -> DataFrame:
    """Trimmed headers; every cell a trimmed string; the exact words nan and None (and null) empty."""
    cells = []
    for i, field in enumerate(df.schema.fields):
        cell = F.col(f"_c{i}").cast("string")
        cells.append(
            tx.strip(F.when(cell.isNull() | cell.isin("nan", "None"), "").otherwise(cell)).alias(field.name.strip())
        )
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*cells)


def read_csv_text(spark: SparkSession, paths: str | list[str], separator: str = ",", with_origin: bool = False) -> DataFrame:
    """Read delimited files as text.  Files of one layout and encoding are read together.

    The header is the first record that isn't blank, line breaks inside quotes included.  A record with more
    fields than the header is an error whichever columns are asked for, and so is a quoted cell that is never closed; nothing
    is dropped.  All files are read in pieces: a file in which quoted cells span lines is put together by ``records``.
    With ``with_origin`` the columns _file (its place among the paths, sorted), _block and _line tell where a row came from.
    """
    found = inspect_files(spark, paths, separator)
    # A header that spans lines is read from its file, so such files are groups of their own.
    alone = F.when(F.col("header_open"), F.col("path"))
    groups = found.groupBy("encoding", "headers", "splittable", alone.alias("alone")).agg(
        F.collect_list(F.struct("path", "header_block")).alias("files")).orderBy("encoding", "headers", "splittable", "alone").collect()
    place = {path: i for i, path in enumerate(sorted(f["path"] for g in groups for f in g["files"]))}
    frames = [_read_group(spark, group, separator, with_origin, place) for group in groups]  # one per file layout
    if not frames:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def readable(uri: str) -> str:
    """The path that a reader takes for a file's URI: without percent signs, and no sign in it is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _headers(spark: SparkSession, group, separator: str) -> list[str]:
    if group["alone"] is None:
        return group["headers"]
    reader = spark.read.option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", True)
    first = reader.option("encoding", "UTF-8" if group["encoding"] == "utf-8" else "ISO-8859-1").csv(readable(group["alone"])).first()
    texts = ["" if h is None else h.removeprefix("\ufeff") for h in first]
    if group["encoding"] == "cp1252":
        texts = [h.encode("latin-1").decode("cp1252") for h in texts]
    return [h.strip() for h in texts]


def _read_group(spark: SparkSession, group, separator: str, with_origin: bool, place: dict[str, int]) -> DataFrame:
    names = unique_names(_headers(spark, group, separator))
    files = {file["path"]: (place[file["path"]], file["header_block"]) for file in group["files"]}
    rows = records(spark, files, separator, whole_lines=group["splittable"])
    text = F.col("value").cast("string")
    if group["encoding"] != "utf-8":
        text = F.decode("value", "ISO-8859-1")
        text = from_cp1252(text) if group["encoding"] == "cp1252" else text
    rows = rows.withColumn("text", text)
    # Parsing hands over records with a wrong number of fields; fewer are filled up, more are an error.
    bad = "_bad"
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(bad, T.StringType())])
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "lineSep": "\n"}
    rows = rows.withColumn("cells", F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
    wrong = F.col(f"cells.{bad}")
    extra = wrong.isNotNull() & (F.when(wrong.isNotNull(), _after_quotes(wrong, separator)["fields"]) > len(names))
    problem = F.concat(F.lit(f"record with more fields than the {len(names)} headers: "), F.substr(wrong, F.lit(1), F.lit(200)))
    # As a filter the check stays in every plan, whichever columns that needs.
    rows = rows.where(F.when(extra, F.raise_error(problem).cast("boolean")).otherwise(True))
    columns = [F.col(f"cells._c{i}") for i in range(len(names))]
    cells = [
        tx.strip(F.when(c.isNull() | c.isin("nan", "None"), "").otherwise(c)).alias(name.strip())
        for c, name in zip(columns, names)
    ]
    if with_origin:
        cells += [F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("line").alias("_line")]
    return rows.select(*cells)


# ---------------------------------------------------------------- records from lines

BLANK = bytes(range(33))
MARK = b"\xef\xbb\xbf"
RECORDS = "file int, block bigint, line bigint, seq bigint, whole boolean, header boolean, value binary"


def left_open(line: bytes, started_open: bool, separator: bytes) -> bool:
    """Whether a quoted cell is open at the end of a line; as ``_after_quotes``, for any start."""
    state = 1 if started_open else 3
    for piece in line.split(b'"')[:-1]:
        state = 2 if state == 1 else 1 if piece.endswith(separator) or (not piece and state >= 2) else 0
    return state == 1


def _parts(line: bytes) -> list[tuple[bytes, bytes]]:
    """A line cut at carriage returns, each part with what ends it; outside quotes each ends a record."""
    if b"\r" not in line:
        return [(line, b"\n")]
    parts = line.split(b"\r")
    if parts[-1]:
        return [(p, b"\r") for p in parts[:-1]] + [(parts[-1], b"\n")]
    return [(p, b"\r") for p in parts[:-2]] + [(parts[-2], b"\r\n")]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, block, lines) of neighbouring lines of one block."""
    files, blocks = batch.column("file").to_numpy(), batch.column("block").to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    edges = [0, *cuts.tolist(), len(files)]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield int(files[start]), int(blocks[start]), batch.column("value").slice(start, end - start)


def _lines(spark: SparkSession, files: dict[str, tuple[int, int]], whole_lines: bool) -> DataFrame:
    """(file, block, value): the lines of files in order; ``file`` is a hash of the path."""
    reader = spark.read if whole_lines else spark.read.option("lineSep", "\n")
    return reader.text([readable(path) for path in files]).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def _block_ends(lines: DataFrame, separator: bytes) -> DataFrame:
    """(file, block, plain, quoted, through): how a block ends if it starts outside or inside a quoted cell, and whether a
    cell that is open at its start stays so all through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ends = None, {}
        for batch in batches:
            for file, block, values in _runs(batch):
                if current != (file, block):
                    current = (file, block)
                    ends[current] = [False, True, True]
                own = ends[current]
                for i in np.flatnonzero(pc.match_substring_regex(values, '["\r]').to_numpy(zero_copy_only=False)).tolist():
                    for part, _ in _parts(_unmarked(values[i].as_py())):
                        own[0], own[1] = left_open(part, own[0], separator), left_open(part, own[1], separator)
                        own[2] = own[2] and own[1]
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "block": b, "plain": e[0], "quoted": e[1], "through": e[2]} for (f, b), e in ends.items()],
            pa.schema([("file", pa.int64()), ("block", pa.int64()), ("plain", pa.bool_()), ("quoted", pa.bool_()), ("through", pa.bool_())]))

    return lines.mapInArrow(run, "file bigint, block bigint, plain boolean, quoted boolean, through boolean")


def _unmarked(line: bytes) -> bytes:
    return line.removeprefix(MARK)


def _open_blocks(spark: SparkSession, files: dict[str, tuple[int, int]], names: dict[int, str], separator: str) -> dict[tuple[int, int], int]:
    """(file, block) of blocks that start inside a quoted cell -> the block in which the record began.

    What a block does to an open or closed quote is one small row, as many as there are tasks to read the files; put one
    after the other they say how each block starts.
    """
    ends = _block_ends(_lines(spark, files, whole_lines=False), separator.encode()).collect()
    owners: dict[tuple[int, int], int] = {}
    last, inside, owner = None, False, 0
    for row in sorted(ends, key=lambda r: (r["file"], r["block"])):
        if row["file"] != last:
            _closed(inside, names.get(last))
            last, inside = row["file"], False
        if inside:
            owners[(row["file"], row["block"])] = owner
        if not (inside and row["through"]):
            owner = row["block"]
        inside = row["quoted"] if inside else row["plain"]
    _closed(inside, names.get(last))
    return owners


def _closed(inside: bool, path: str | None) -> None:
    if inside:
        raise ValueError(f"a quoted cell is not closed at the end of {path}")


def records(spark: SparkSession, files: dict[str, tuple[int, int]], separator: str = ",", whole_lines: bool = False) -> DataFrame:
    """(file, block, line, value): the records of files {path: (number, block of the header)}, without headers and blank lines.

    With ``whole_lines`` each line is a record.  Otherwise a first pass says for every block whether it starts inside a
    quoted cell; then each block puts its own records together, and those that reach over blocks are joined from their pieces.
    """
    # The reader hands out paths as URIs; their hashes name them in the workers.
    named = spark.createDataFrame([(path,) for path in files], "path string").select("path", F.xxhash64("path").alias("hash")).collect()
    names = {row["hash"]: row["path"] for row in named}
    if len(names) < len(files):
        raise ValueError("two paths share a hash")
    known = {key: files[path] for key, path in names.items()}
    owners = {} if whole_lines else _open_blocks(spark, files, names, separator)
    mark = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = None, None
        for batch in batches:
            for file, block, values in _runs(batch):
                if current != (file, block):
                    if reader is not None:
                        yield from reader.rest()
                    current = (file, block)
                    number, header = known[file]
                    reader = _Block(number, block, header == block, owners.get(current), mark)
                yield from reader.lines(values) if whole_lines else reader.quoted(values)
        if reader is not None:
            yield from reader.rest()

    found = _lines(spark, files, whole_lines).mapInArrow(run, RECORDS)
    if not whole_lines:
        found = materialise(found, "records")
        whole = found.where("whole").select("file", "block", "line", "value")
        pieces = found.where("not whole").groupBy("file", "block").agg(
            F.min("line").alias("line"), F.bool_or("header").alias("header"),
            F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda p: p["value"]).alias("values"))
        joined = F.aggregate("values", F.lit(b""), lambda done, piece: F.concat(done, piece))
        return whole.union(pieces.where("not header").select("file", "block", "line", joined.alias("value")))
    return found.select("file", "block", "line", "value")


class _Block:
    """The records of one block, batch by batch."""

    def __init__(self, file: int, block: int, has_header: bool, owner: int | None, separator: bytes):
        self.file, self.block, self.has_header, self.owner, self.separator = file, block, has_header, owner, separator
        self.line, self.waiting, self.started, self.inside = 0, [], 0, owner is not None

    def batch(self, lines: list[int | None], values: pa.Array | list[bytes], seq: int = 0, whole: bool = True, header: bool = False,
              block: int | None = None) -> pa.RecordBatch:
        n = len(lines)
        same = [(self.file, pa.int32()), (self.block if block is None else block, pa.int64())]
        columns = [pa.repeat(pa.scalar(v, kind), n) for v, kind in same] + [pa.array(lines, pa.int64())]
        columns += [pa.repeat(pa.scalar(v, kind), n) for v, kind in ((seq, pa.int64()), (whole, pa.bool_()), (header, pa.bool_()))]
        columns.append(values if isinstance(values, pa.Array) else pa.array(values, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "line", "seq", "whole", "header", "value"])

    def lines(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        """Each line is a record; blank ones go, and the first other one if the header is due."""
        numbers = np.arange(self.line, self.line + len(values))
        self.line += len(values)
        filled = pc.match_substring_regex(values, r"[^\x00-\x20]").to_numpy(zero_copy_only=False)
        if self.has_header:
            for i in np.flatnonzero(filled).tolist():
                filled[i] = False
                if _unmarked(values[i].as_py()).strip(BLANK):
                    self.has_header = False
                    break
        if filled.any():
            yield self.batch(numbers[filled].tolist(), values.filter(pa.array(filled)))

    def quoted(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        numbers, found = [], []
        for value in values.to_pylist():
            if self.line == 0:
                value = _unmarked(value)
            for part, end in _parts(value):
                self.line += 1
                if not self.waiting:
                    self.started = self.line
                if (b'"' in part and left_open(part, self.inside, self.separator)) or (b'"' not in part and self.inside):
                    self.inside = True
                    self.waiting.append(part + end)
                    continue
                self.inside = False
                record = b"".join([*self.waiting, part])
                self.waiting = []
                if self.owner is not None:
                    # The end of a record that began in an earlier block.
                    yield self.batch([None], [record], seq=self.block, whole=False, block=self.owner)
                    self.owner = None
                elif record.strip(BLANK):
                    if self.has_header:
                        self.has_header = False
                    else:
                        numbers.append(self.started)
                        found.append(record)
        if found:
            yield self.batch(numbers, found)

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What goes on in the next block."""
        if self.waiting:
            begun, line = (self.block, self.started) if self.owner is None else (self.owner, None)
            yield self.batch([line], [b"".join(self.waiting)], seq=self.block, whole=False, header=self.has_header, block=begun)
            self.waiting = []
