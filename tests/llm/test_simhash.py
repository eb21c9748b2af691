import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from belegwerk.llm import simhash
from belegwerk.llm.components import components


def plain_fingerprint(text, size=4):
    w = [x for x in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if x]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    ids = sorted(fps, key=lambda k: k)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprint(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 60):
        text = "\t ".join(rng.choice(["Ab", "cd", "éF", "g"]) for _ in range(n))
        assert unsigned(simhash.fingerprint(text)) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert unsigned(simhash.fingerprint(text)) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("segments, dense, radius", [(2, 1000, 4), (3, 3, 4), (4, 3, 4), (2, 3, 3), (3, 1000, 3)])
def test_links_keep_components(spark, ws, monkeypatch, segments, dense, radius):
    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(12):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(8):
            fps.add(at)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                at ^= 1 << int(b)
    monkeypatch.setattr(simhash, "segments_for", lambda n, radius=4: segments)
    monkeypatch.setattr(simhash, "DENSE", dense)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = simhash.links(ws, frame, len(fps), radius)
    roots = {r.node: r.root for r in components(ws, edges).collect()}
    got = {f: unsigned(roots.get(simhash._signed(f), simhash._signed(f))) for f in fps}
    want = plain_components({f: f for f in fps}, radius)

    def parts(x):
        return {frozenset(f for f in fps if x[f] == r) for r in set(x.values())}

    assert parts(got) == parts(want)


def test_near_duplicates_and_representatives(spark, ws):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(60):
        text = list(base[i % 6])
        for _ in range(i % 4):
            text[rng.randrange(300)] = rng.choice(words)
        rows.append((100 - i, " ".join(text)))
    rows += [(500, ""), (501, None), (502, "  ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(ws, frame).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {r.doc_id: unsigned(r.fp) for r in got} == fps
    want = plain_components(fps)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.representatives(ws, frame)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_components(spark, ws):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (7, 7), (-5, 300)]
    frame = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.root for r in components(ws, frame).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100: -5, 200: -5, 300: -5}
    assert components(ws, frame.limit(0)).count() == 0


def test_odd_rows(ws, odd, none):
    got = simhash.near_duplicates(ws, odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.where(F.col("fp") == 0).collect()} == {2}
    kept = simhash.representatives(ws, odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, -7), (False, 1), (False, 2), (False, 5), (True, 0), (True, 0)]
    assert simhash.near_duplicates(ws, none).count() == 0 and simhash.representatives(ws, none).count() == 0


def test_segments_follow_the_size():
    assert [simhash.segments_for(n) for n in (10, 10**5, 10**7, 10**10)] == sorted([simhash.segments_for(n) for n in (10, 10**5, 10**7, 10**10)], reverse=True)
