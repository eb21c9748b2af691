import random
import re
import time

import numpy as np
import pytest

from belegwerk.llm import jaccard_join


def plain_set(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, percent=85):
    """Components by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def near_copies(rng, text, edits, pool):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        what = rng.random()
        if what < 0.5:
            out[at] = rng.choice(pool)
        elif what < 0.8:
            out.insert(at, rng.choice(pool))
        elif len(out) > 1:
            del out[at]
    return out


def corpus(seed, families, copies):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    common = [rng.choice(pool) for _ in range(30)]
    rows = []
    for _ in range(families):
        base = [rng.choice(pool) for _ in range(rng.choice([3, 4, 6, 9, 10, 40, 120]))]
        for _ in range(rng.randint(1, copies)):
            text = near_copies(rng, base, rng.randrange(6), pool)
            rows.append((text + common if rng.random() < 0.5 else text))
    rng.shuffle(rows)
    return [(1000 - i, " ".join(t)) for i, t in enumerate(rows)]


def found(spark, ws, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in jaccard_join.join(ws, frame, **how).collect()), key=repr)


def test_same_as_all_pairs(spark, ws):
    rows = corpus(1, 60, 6)
    assert found(spark, ws, rows) == plain(rows)


@pytest.mark.parametrize("rounds, gain", [(0, 1.5), (2, 1.5), (1, 9.0)])
def test_large_regions_are_split(spark, ws, monkeypatch, rounds, gain):
    monkeypatch.setattr(jaccard_join, "SLICE", 16)
    monkeypatch.setattr(jaccard_join, "GAIN", gain)
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(200)]
    base = [rng.choice(pool) for _ in range(60)]
    rows, text = [], base
    for i in range(150):
        # A chain of near copies that drifts away from its start, and copies of the start.
        text = near_copies(rng, text if i % 2 else base, 2 if i % 2 else 4, pool)
        rows.append((i, " ".join(text)))
    assert found(spark, ws, rows, leaf=10, rounds=rounds) == plain(rows)


def test_region_in_a_task():
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(60)]
    for _ in range(6):
        base = [rng.choice(pool) for _ in range(50)]
        texts = [" ".join(near_copies(rng, base, rng.randrange(12), pool)) for _ in range(90)]
        sets = [jaccard_join.shingle_set(t) for t in texts]
        known = jaccard_join.join_region(sets, direct=9)
        want = plain(list(enumerate(texts)))
        got = sorted(((i, len(s), min(j for j in range(90) if known.find(j) == known.find(i))) for i, s in enumerate(sets)), key=repr)
        assert got == want


def test_overlaps_and_threshold(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 3)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(12)]
    both, either = jaccard_join.overlaps(sets)
    some, all_ = jaccard_join.overlaps_with(sets[:3], sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert (both[i, j], either[i, j]) == (len(x & y), len(x | y))
            assert i > 2 or (some[i, j], all_[i, j]) == (len(x & y), len(x | y))
    for n in range(1, 60):
        sizes = [m for m in range(1, 90) if m != n and 100 * min(n, m) >= 85 * max(n, m)]
        assert jaccard_join.can_link(n) == bool(sizes)
        assert all(i >= jaccard_join.needed(n) for m in range(1, 90) for i in range(min(n, m) + 1) if 100 * i >= 85 * (n + m - i))


def test_exact_border(spark, ws):
    # 17 of 20 shingles in common is 85 percent, 16 of 19 is less.
    head = [f"h{i}" for i in range(20)]
    rows = [(1, " ".join(head)), (2, " ".join(head + ["a", "b", "c"]))]
    other = [f"k{i}" for i in range(19)]
    rows += [(3, " ".join(other)), (4, " ".join(other + ["a", "b", "c"]))]
    assert found(spark, ws, rows) == [(1, 17, 1), (2, 20, 1), (3, 16, 3), (4, 19, 4)]


def test_odd_rows(ws, odd, none):
    got = [tuple(r) for r in jaccard_join.join(ws, odd).collect()]
    assert len(got) == odd.count()
    by_id = {}
    for k, n, c in got:
        by_id.setdefault(k, []).append((n, c))
    assert by_id[1] == [(6, 1)] * 2 and by_id[2] == by_id[3][:0] + [(0, 2)] and by_id[3] == [(0, 3)] and by_id[4] == [(0, 4)]
    assert sorted(by_id[None]) == [(0, None), (2, None)]
    assert jaccard_join.join(ws, none).count() == 0


def test_salt_parts_equal_names(spark, ws, monkeypatch):
    real, salts = jaccard_join.described, []

    def clash(docs, shingle, percent, salt):
        salts.append(salt)
        from pyspark.sql import functions as F

        rows = real(docs, shingle, percent, salt)
        return rows.withColumn("x", F.lit(5).cast("long")) if not salt else rows

    monkeypatch.setattr(jaccard_join, "described", clash)
    rows = [(1, "a b c d e"), (2, "f g h i j")]
    assert found(spark, ws, rows) == [(1, 2, 1), (2, 2, 2)] and salts == [0, 1]


def shuffle_bytes(spark):
    sc = spark.sparkContext
    files = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_stages_drop_their_shuffles(spark, ws):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    frame = ws.stage(spark.createDataFrame(corpus(3, 60, 4), "doc_id long, text string"), "documents")
    before, setting = shuffle_bytes(spark), spark.conf.get(key)
    jaccard_join.join(ws, frame)
    for _ in range(20):
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffle_bytes(spark) <= before and spark.conf.get(key) == setting


def test_bytes_of_a_held_shingle_do_not_grow_with_partitions(spark, ws):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices([f"v{j}" for j in range(9000)], k=300))) for i in range(1500)]
    sets = ws.stage(jaccard_join.described(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 4, 85, 0), "sets")
    held = jaccard_join.held_shingles(ws, sets)
    total = held.count()
    assert total == sets.selectExpr("sum(size(held))").first()[0] > 90_000

    def moved(parts):
        before = shuffle_bytes(spark)
        held.repartition(parts, "s").write.format("noop").mode("overwrite").save()
        return (shuffle_bytes(spark) - before) / total

    few, many = moved(4), moved(40)
    assert many < 1.1 * few and many < 16


def test_copies_hold_once(spark, ws):
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"v{j}" for j in range(900)], k=80)) for _ in range(12)]
    frame = spark.createDataFrame([(i, texts[i % 12]) for i in range(96)], "doc_id long, text string").repartition(6)
    sets = ws.stage(jaccard_join.described(frame, 4, 85, 0), "sets")
    held = jaccard_join.held_shingles(ws, sets)
    assert held.count() == held.select("s").distinct().count() > 0
    assert sets.where("have <> size(held)").isEmpty() and sets.select("i").distinct().count() == 96


@pytest.mark.parametrize("bits", [5, 12])
def test_short_hashes_lose_no_link(spark, ws, monkeypatch, bits):
    # Shingles that cannot be told apart where partners are looked for only add candidates.
    monkeypatch.setattr(jaccard_join, "BITS", bits)
    rows = corpus(13, 40, 6)
    assert found(spark, ws, rows) == plain(rows)
