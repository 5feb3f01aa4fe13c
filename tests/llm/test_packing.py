import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recordloom.llm.packing import pack, pack_digest


def check(docs, most_padding):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(d.doc_id), tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2]) for d in docs.collect())
    rows = pack(docs).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        windows[r.sequence_id].append((r.offset, len(ids)))
        pieces[str(r.doc_id), r.doc_tokens].append((r.start, ids))
    for parts in windows.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= 4096
    total = sum(len(ids) for _, ids in want)
    assert len(windows) * 4096 - total <= most_padding * 4096
    # Repeated documents share a key, so their pieces are compared as bags.
    bag = defaultdict(list)
    for doc, ids in want:
        bag[doc, len(ids)].append(ids)
    for key, lists in bag.items():
        got = pieces.pop(key)
        assert sum(len(i) for _, i in got) == sum(map(len, lists))
        if len(lists) == 1:
            assert [t for _, i in sorted(got) for t in i] == lists[0]
    assert not pieces
    return rows


def test_every_id_lies_in_one_piece(documents, odd):
    check(documents.repartition(3), 2)
    check(odd, 2)


def test_checksums_and_special_strings(spark):
    docs = spark.createDataFrame([(1, "A <|endoftext|>b it's 12\t3 x É é"), (2, "x<|startoftext|> <|START|>")], "doc_id bigint, text string")
    check(docs, 1)
    by = {r.doc_id: r for r in pack_digest(docs).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in docs.collect():
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [2]
        assert by[d.doc_id].length == len(ids) == by[d.doc_id].doc_tokens
        assert by[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_empty_table(empty):
    assert pack_digest(empty).collect() == []
