"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from belegwerk.llm import suffixes


def brute(rows, length=suffixes.LENGTH):
    first, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in first:
                gone[s : s + length] = True
            else:
                first[window] = (doc, s)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc] = (len(data), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())
    return out


def texts(seed=1, n=60):
    rng = random.Random(seed)
    letters = "abcdefgh ä\n"
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [word(k) for k in (40, 99, 100, 101, 130, 400, 900)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else word(rng.randint(0, 300)))
            if rng.random() < 0.2:
                piece = rng.choice(shared)
                a = rng.randint(0, len(piece) // 2)
                parts.append(piece[a : a + rng.randint(0, len(piece))])
        rows.append((i * 3 - 20, "".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    rows += [(2000, "x" * 350), (2001, "ab" * 200), (2002, None), (2003, ""), (2004, "x" * 5000)]
    return rows


@pytest.mark.parametrize(("hot_rows", "dense_rows"), [(suffixes.HOT_ROWS, suffixes.DENSE_ROWS), (3, 10**9), (10**9, 1)])
def test_remove_repeats_equals_brute_force(spark, ws, hot_rows, dense_rows):
    rows = texts()
    frame = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, kept string")
    found = suffixes.remove_repeats(ws, frame.repartition(5), hot_rows=hot_rows, dense_rows=dense_rows).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert len(found) == len(rows)
    assert got == brute(rows)


def test_repeated_rows_null_keys_and_empty_table(spark, ws):
    long = "The same passage of some length stands here and there, and it must be longer than a hundred bytes."
    rows = [(1, long * 2), (1, long * 2), (2, long + "!" + long), (None, long * 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.remove_repeats(ws, frame).collect()
    want = brute([r for r in rows if r[0] is not None])
    for r in found:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.n_spans == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert len(found) == 4
    assert suffixes.remove_repeats(ws, frame.limit(0)).count() == 0


def test_merged_order_is_the_order_of_all_suffixes():
    rng = np.random.default_rng(3)
    shards = [np.append(rng.integers(1, 4, k), 0) for k in (50, 1, 200, 33)]
    transforms = [suffixes.transform(s) for s in shards]
    shard, block = suffixes.merge_transforms([t[0] for t in transforms], 6)
    seen, keys = [0] * len(shards), []
    for s in shard.tolist():
        at = transforms[s][1][seen[s]]
        seen[s] += 1
        keys.append(tuple(np.roll(shards[s], -at)[np.arange(6) % len(shards[s])]))
    assert keys == sorted(keys)
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], block.tolist(), block.tolist()[1:]))


def test_pieces_of_a_long_text(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8))
    whole = suffixes.segments(data)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    pieces = suffixes.segments(data)

    def anchors(found):
        return [(int(h), int(p), s) for h, p, a, n in zip(*found) for s in range(a, a + n - suffixes.LENGTH + 1)]

    assert anchors(whole) == anchors(pieces)


def test_odd_rows(ws, odd, none):
    got = suffixes.remove_repeats(ws, odd)
    assert got.count() == odd.count() and suffixes.remove_repeats(ws, none).count() == 0
    assert got.where("doc_id = 2").first().n_bytes == 0
