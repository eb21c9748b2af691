import hashlib
import random
import zlib

import pytest

from belegwerk.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes from the rebuilt conversations, by plain prefixes."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = set()
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        children = sum(len(p) == len(path) + 1 for p in below)
        out.add((min(cs), len(path), parent, len(cs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(rng, n, deepest):
    rows = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 5, 9, deepest])
        turns = [(rng.choice("ua"), " ".join(rng.choice("xyz") for _ in range(rng.randrange(3)))) for _ in range(size)]
        if c % 7 == 0:
            turns = [("u", "same start here")] * 6 + turns
        if c % 11 == 0:
            turns = [("u", "one two"), ("a", "three")]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("single, group_turns", [(1, 10**6), (2, 10**6), (2, 5), (8, 10**6)])
def test_same_as_plain_prefixes(spark, ws, single, group_turns):
    rows = talk(random.Random(single), 60, 21)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = prefix_trie.trie(ws, frame, single=single, group_turns=group_turns)
    assert got.columns == COLUMNS
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_chunked_ends(spark, ws, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_KEYS", 3)
    rows = [(c, 0, "u", "same") for c in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert {tuple(r) for r in prefix_trie.trie(ws, frame).collect()} == plain(rows)


def test_odd_rows(spark, ws):
    rows = [(0, None, "u", "first"), (0, None, "u", "first"), (0, 1, None, None), (3, 2, "u", "a\tb \n c\x0b"), (3, 1, "u", "é ß"), (None, 0, "u", "lost"), (20, 0, "", ""), (41, 0, "u", "no base"), (61, 1, "u", " ")]
    rows += [(-7, 1, "u", "below zero")]
    schema = "conv_id long, turn long, role string, text string, key string, depth long, saved long"
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], schema)
    found = [tuple(r) for r in prefix_trie.trie(ws, frame).collect()]
    # Spark and SQL take the remainder of a negative number below zero, so -7 is built on 0.
    assert len(found) == len(set(found)) and sum(f[1] == 0 for f in found) == 1
    root = next(f for f in found if f[1] == 0)
    assert root[0] == -7 and root[2] is None and root[3] == 6
    again = [r for r in rows if r[0] != -7]
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in again], schema)
    assert {tuple(r) for r in prefix_trie.trie(ws, frame).collect()} == plain(again)
    assert prefix_trie.trie(ws, frame.limit(0)).count() == 0 and prefix_trie.trie(ws, frame.limit(0)).columns == COLUMNS
    long = [(5, i, "u", "w " * (i % 3)) for i in range(3000)] + [(6, 0, "u", "x " * 100_000)]
    frame = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(ws, frame).collect()
    assert max(r.depth for r in got) >= 2998
    assert prefix_trie.bands(100, 8) == [(64, 100), (32, 64), (16, 32), (8, 16)] and prefix_trie.bands(8, 8) == []
