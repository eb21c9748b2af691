import random
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

from belegwerk.llm import ppm


def plain_log10(counts, context, symbol):
    """Escape method C with exclusion, straight from the counts of every context."""
    out, excluded = 0.0, set()
    for k in range(len(context), -1, -1):
        seen = counts.get(tuple(context[len(context) - k :]))
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        if left:
            bottom = sum(left.values()) + len(left)
            if symbol in left:
                return out + log10(left[symbol] / bottom)
            out += log10(len(left) / bottom)
        excluded |= set(seen)
    return out - log10(ppm.ALPHABET - len(excluded))


def plain_model(texts, order):
    counts = defaultdict(Counter)
    for t in texts:
        s = [ppm.END] * order + list(t) + [ppm.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    return counts


def documents():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        n = rng.choice([0, 1, 8, 30])
        rows.append((i, " ".join(rng.choice(["Anna", "anne", "bob", "Übel", "x\ny"]) for _ in range(n)) if i % 17 else None))
    return rows


@pytest.mark.parametrize("order", [1, 3, 5])
def test_scores_equal_plain_counts(spark, ws, order):
    rows = documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ppm.score(ws, frame, order=order, block_bytes=500).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    data = {i: (t or "").encode().lower() for i, t in rows}
    train = [data[i] for i, _ in rows if not held[i]]
    counts = plain_model(train, order)
    words = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    assert len(got) == len(rows)
    for i, _ in rows:
        s = [ppm.END] * order + list(data[i]) + [ppm.END]
        want = sum(plain_log10(counts, s[k - order : k], s[k]) for k in range(order, len(s)))
        assert got[i].score == pytest.approx(want, rel=1e-9)
        tokens = [*data[i].split(), None]
        base = sum(log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(tokens), sum(words[w] > 0 for w in tokens), n, held[i])


def test_values_are_a_distribution_after_every_context(spark, ws):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaabbc de") for _ in range(400)).encode() for _ in range(8)]
    keys, counts = ppm.gram_counts(iter(texts), iter([b"zebra ada"]), 3)
    assert counts.sum() == sum(len(t) + 1 for t in texts) and (counts == 0).any()
    contexts = {int(g) // 257 for g in keys[::29]} | {int(g) // 257 for g in keys[counts == 0]}
    rows = list(zip(keys.tolist(), counts.tolist())) + [(c * 257 + s, 0) for c in contexts for s in range(257)]
    values = ppm.gram_values(ws, spark.createDataFrame(rows, "key long, n long"), 3)
    sums = defaultdict(float)
    for r in values.collect():
        sums[r.key // 257] += 10**r.value
    assert len(contexts) > 20 and all(sums[c] == pytest.approx(1, abs=1e-9) for c in contexts)


def test_the_model_grows_with_its_texts(spark, ws, monkeypatch):
    monkeypatch.setattr(ppm, "HELD_GRAMS", 50)
    monkeypatch.setattr(ppm, "CHUNK", 100)
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(256), k=300)) for _ in range(12)]
    keys, counts = ppm.gram_counts(iter(texts), iter([]), 5)
    plain = plain_model(texts, 5)
    assert len(keys) == sum(len(seen) for context, seen in plain.items() if len(context) == 5)
    assert counts.sum() == 12 * 301


def test_odd_rows(spark, ws, odd, none):
    got = ppm.score(ws, odd)
    assert got.count() == odd.count()
    assert got.where("score is null or base_score is null").count() == 0
    assert ppm.score(ws, none).count() == 0
    (one,) = ppm.score(ws, spark.createDataFrame([(1, "ab")], "doc_id long, text string"), folds=1, held=0).collect()
    assert one.held_out and one.score == pytest.approx(-3 * log10(257)) and one.n_known == 0 and one.train_tokens == 0
