"""Packing token sequences into windows of fixed length: bounded-space best fit.

Each partition keeps at most ``open_windows`` windows.  A document goes to the window it fills best; when none has
room the fullest is topped up with the document's head and emitted, and the rest opens a new one.  What is open at
the end of a partition is a leftover; the leftovers of neighbouring partitions are merged, one window running into
the next, so that padding is left in one window of each merge group.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm.common import kept_as_table

LENGTH = 4_096
OPEN_WINDOWS = 16
MERGED_BITS = 5  # leftovers of 2 ** 5 neighbouring partitions are merged together
CACHED = 800_000  # words; about 200 bytes each in every worker
LONGEST_CACHED = 64
ID_BYTES = 4
PIECES = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, open boolean"


@cache
def tokenizer(name: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path(name))


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else the
    next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = {byte: 256 + at for at, byte in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(byte, byte)) for byte in range(256)]


class WordIds(dict):
    """White-space delimited word -> its ids as little-endian unsigned 32-bit integers.

    The vocabulary's pre-tokens hold no white space, so a text's ids are those of its words in order.  A word of
    ASCII signs and Latin letters is its own normal form once it is lower case; its pre-tokens go straight to the
    library's merges.  Any other word, and one that may hold a special string, takes the library's whole way.
    """

    letters = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
    simple = re.compile(f"([{letters}]+)([!-&(-/:-@\\[-`{{-~]*)").fullmatch
    plain = re.compile(f"[!-~{letters}]+").fullmatch
    parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+").findall
    shown = printable_bytes()

    def __init__(self, name: str):
        super().__init__()
        self.encode, self.merge = tokenizer(name).encode, tokenizer(name).model.tokenize
        self.packed = [i.to_bytes(ID_BYTES, "little") for i in range(tokenizer(name).get_vocab_size())]

    def merged(self, part: str) -> bytes:
        """The ids of one pre-token in lower case."""
        if not part.isascii():
            part = "".join([self.shown[b] for b in part.encode()])
        packed = self.packed
        return b"".join([packed[token.id] for token in self.merge(part)])

    def ids(self, word: str) -> bytes:
        simple = self.simple(word)
        if simple:  # letters, perhaps with signs after them: two pre-tokens at most
            core, signs = simple.groups()
            return self[core] + self[signs] if signs else self.merged(core.lower())
        if self.plain(word) and "<|" not in word:
            return b"".join(map(self.merged, self.parts(word.lower())))
        return np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word) if word else b""
        if len(word) <= LONGEST_CACHED:
            if len(self) > CACHED:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class Windows:
    """The open windows of one partition; ``rows`` collects the pieces of windows that are done."""

    def __init__(self, partition: int, length: int, most: int):
        self.base, self.length, self.most = partition << 32, length, most
        self.open: list[tuple[int, list]] = []
        self.rows: list[tuple] = []
        self.count = 0

    def emit(self, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.base + self.count, offset, is_open))
            offset += len(ids) // ID_BYTES
        self.count += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // ID_BYTES
        start = 0
        while total - start >= self.length:
            self.emit([self.piece(doc, ids, start, start + self.length, total)])
            start += self.length
        need = total - start
        if not need:
            return
        fits = [i for i, (used, _) in enumerate(self.open) if self.length - used >= need]
        if fits:
            best = max(fits, key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(best)
            pieces.append(self.piece(doc, ids, start, total, total))
            self.keep(used + need, pieces)
            return
        if len(self.open) == self.most:
            used, pieces = self.open.pop(max(range(self.most), key=lambda i: self.open[i][0]))
            room = self.length - used
            pieces.append(self.piece(doc, ids, start, start + room, total))
            self.emit(pieces)
            start += room
        self.keep(total - start, [self.piece(doc, ids, start, total, total)])

    def keep(self, used: int, pieces: list) -> None:
        if used == self.length:
            self.emit(pieces)
        else:
            self.open.append((used, pieces))

    @staticmethod
    def piece(doc: int | None, ids: bytes, start: int, end: int, total: int) -> tuple:
        return doc, start, ids[start * ID_BYTES: end * ID_BYTES], total

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 7
        self.rows = []
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open"])


def merge(pieces: pd.DataFrame, length: int) -> pd.DataFrame:
    """Leftover pieces in order, poured into windows; a piece that crosses a border is cut there."""
    rows, used, sequence = [], 0, (1 << 62) + (int(pieces["_group"].iloc[0]) << 32)
    for row in pieces.sort_values(["sequence_id", "offset"]).itertuples(index=False):
        doc = None if pd.isna(row.doc_id) else int(row.doc_id)
        at, size = 0, len(row.ids) // ID_BYTES
        while at < size:
            take = min(size - at, length - used)
            rows.append((doc, row.start + at, row.ids[at * ID_BYTES: (at + take) * ID_BYTES], row.doc_tokens,
                         sequence, used))
            at, used = at + take, used + take
            if used == length:
                used, sequence = 0, sequence + 1
    out = pd.DataFrame(rows, columns=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])
    return out.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 2, length: int = LENGTH,
         open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): the pieces of all windows over ``docs`` (doc_id, text).

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers; ``start`` is how many of its
    document's ids come before it, ``offset`` how many of its window's.  Every document ends with ``end_id``; a null
    or empty text is that id alone.  Repeated rows are packed each.  Other columns are left out.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(name), end_id.to_bytes(ID_BYTES, "little")
        windows = Windows(TaskContext.get().partitionId(), length, open_windows)
        for batch in batches:
            size = 0
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = words.of(text.as_py() or "") + end
                windows.add(doc.as_py(), ids)
                size += len(ids)
                if size > 16_000_000:
                    yield windows.taken()
                    size = 0
            yield windows.taken()
        for _, pieces in windows.open:
            windows.emit(pieces, is_open=True)
        yield windows.taken()

    # Written once: windows that are done and leftovers have to come from the same run of a partition.
    placed = kept_as_table(docs.select("doc_id", "text").mapInArrow(place, PIECES), "packed")
    columns = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    group = F.shiftright("sequence_id", 32 + MERGED_BITS)
    merged = placed.where("open").select(*columns, group.alias("_group")).groupBy("_group").applyInPandas(
        lambda pieces: merge(pieces, length),
        "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return placed.where("not open").select(*columns).unionByName(merged)


def pack_digest(docs: DataFrame) -> DataFrame:
    """Pieces with their length and checksum in place of the ids."""
    return pack(docs).select(
        "doc_id", "start", (F.octet_length("ids") / ID_BYTES).cast("bigint").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
