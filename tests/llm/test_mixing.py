import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from belegwerk.llm import mixing


def best_sum(sizes, counts, budget):
    reach = {0}
    for w, n in zip(sizes, counts):
        reach = {s + w * k for s in reach for k in range(n + 1) if s + w * k <= budget}
    return max(reach)


def test_knapsack_is_exact_within_the_window():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(1, 6)
        sizes = rng.sample(range(1, 40), n)
        counts = [rng.randint(1, 5) for _ in range(n)]
        budget = rng.randint(0, sum(w * c for w, c in zip(sizes, counts)))
        taken = mixing.fit_counts(np.array(sizes), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert int((taken * sizes).sum()) == best_sum(sizes, counts, budget)


def test_large_budgets_come_close():
    rng = np.random.default_rng(2)
    sizes = np.arange(3, 3000)
    counts = rng.integers(1, 50, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (0, 1, 2, total // 3, total - 1, total, total + 5):
        taken = mixing.fit_counts(sizes, counts, budget, window=5000)
        assert (taken >= 0).all() and (taken <= counts).all()
        found = int((taken * sizes).sum())
        assert found <= budget and (min(budget, total) - found <= 2)


def plain_targets(size):
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * size[s] if s in full else rest * weight[s] / weights for s in order}
        above = {s for s in order if target[s] > 3 * size[s]}
        if not above:
            return target
        full |= above


def documents(seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(600):
        source = rng.choice(["a"] * 8 + ["b", "é", "Z", "", "c", None, "d"])
        n = rng.choice([0, 1, 5, 5, 17, rng.randint(0, 300)])
        out.append((i, rng.choice([" ", "\t\n"]).join("w" * rng.randint(1, 3) for _ in range(n)) if rng.random() < 0.95 else None, source))
    return out


def test_mix(spark, ws):
    rows = documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(ws, frame).collect()
    assert sorted(got) == sorted(mixing.mix(ws, frame.repartition(3)).collect())
    sizes = {i: len((t or "").encode().split()) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += sizes[i]
    want = plain_targets(by_source)
    taken = defaultdict(int)
    for r in got:
        assert r.size == sizes[r.doc_id] and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_odd_rows(ws, odd, none):
    got = mixing.mix(ws, odd)
    assert got.count() == odd.count()
    assert mixing.mix(ws, none).count() == 0
    blank = mixing.mix(ws, odd.where("text is null or text = ''")).collect()
    assert {(r.size, r.taken, r.target) for r in blank} == {(0, 0, 0.0)}
