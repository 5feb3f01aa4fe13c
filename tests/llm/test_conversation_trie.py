import hashlib
import math
import zlib
from collections import defaultdict

import pytest

from recordloom.llm import conversation_trie as module
from recordloom.llm.conversation_trie import numbered, prefix_trie, rebuilt_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sequences(rows, every=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [t[2:] for t in sorted(found)] for c, found in own.items()}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        full[c] = tuple(turns.get(c - int(math.fmod(c, every)), [])[:h] + turns[c][h:])
    return full


def expected(full):
    members, kids = defaultdict(list), defaultdict(int)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return sorted((
        min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), kids[path], leaves[path], saved[path],
        hashlib.sha256(",".join(map(str, sorted(c for c in convs if full[c] == path))).encode()).hexdigest())
        for path, convs in members.items())


def nodes(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in frame.collect())


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert nodes(rebuilt_trie(table)) == expected(sequences([tuple(r) for r in table.select(*SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")).collect()]))


ODD = (
    [(c, t, "user", "same") for c in range(40) for t in range(4)]  # copies, and beginnings of one another
    + [(c, t, "user", f"{c % 3}" if t == 20 else "same") for c in range(100, 120) for t in range(30)]
    + [(200, None, None, None), (200, None, None, ""), (200, 0, "user", None), (200, 0, None, "user"), (200, 0, None, "user")]
    + [(None, 1, "user", "nobody's"), (203, 7, "a", "x"), (204, 7, "a", "x"), (-7, 1, "b", "ü" * 10), (-5, 2, "b", "y" * 100_000)]
    + [(300 + i, 1, "user", f"only {i}") for i in range(30)]
)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_odd_rows_and_blocks(spark, block, monkeypatch):
    """Nulls, repeated rows, conversations without a turn left, negative numbers, and columns of clashing names."""
    monkeypatch.setattr(module, "CHUNK", 4)
    monkeypatch.setattr(module, "PART", 5)
    frame = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as pos", "'x' as node", "2 as depth", "3 as _n", "4 as h1")
    turns, whole = module.shared_beginnings(numbered(frame))
    assert nodes(prefix_trie(turns, whole, block)) == expected(sequences(ODD))


def test_nothing(spark):
    assert rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_a_long_conversation(spark, monkeypatch):
    """Digests go on from part to part, sums take nine rounds."""
    monkeypatch.setattr(module, "PART", 64)
    rows = [(c, t, "user", "last" if c and t == 300 else "t") for c in (0, 1_000_000) for t in range(300 + c % 7)]
    full = {c: tuple((b"user", text.encode()) for d, _, _, text in rows if d == c) for c in (0, 1_000_000)}
    frame = spark.createDataFrame(rows, SCHEMA)
    turns = numbered(frame)
    whole = turns.groupBy("conv_id").agg({"pos": "max"}).withColumnRenamed("max(pos)", "total")
    assert nodes(prefix_trie(turns, whole)) == expected(full)
