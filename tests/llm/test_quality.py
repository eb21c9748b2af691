import random

import numpy as np
from pyspark.sql import functions as F

from belegwerk.llm import quality


def corpus(n=600):
    rng = random.Random(5)
    words = ["river", "stone", "the", "of", "and", "light", "tree", "house", "walks", "green"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if not good:
            text = [w + "***" for w in text] if i % 2 else [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(good), "clash"))
    good = {i: "***" not in t and "!!" not in t for i, t in rows}
    return rows, labels, good


def test_held_out_accuracy_and_reruns(spark, ws):
    rows, labels, good = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = quality.score(frame, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 50 < len(held) < 250
    assert np.mean([(r.predicted == 1) == good[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    again = {r.doc_id: r.score for r in quality.score(frame, marks).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in got) < 1e-3


def test_held_out_labels_teach_nothing(spark, ws):
    rows, labels, _ = corpus(300)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    turned = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score(frame, marks).collect()}
    b = {r.doc_id: r.score for r in quality.score(frame, turned).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-3


def test_tokens_and_pool():
    bucket, of = quality.token_buckets([b"Ab ab,", b"", b"ABC 12 34", "é**".encode()])
    assert of.tolist() == [0, 0, 0, 2, 2, 2, 3, 3]
    assert bucket[0] == bucket[1] and bucket[3] == quality._CAPITALS and bucket[4] == bucket[5] == quality._DIGITS
    vectors = quality.index_vectors()
    x = quality.pool([b"Ab ab,", b"", b"x"], quality.with_squares(vectors))
    assert x.shape == (3, 2 * quality.DIMS + 1) and not x[1].any()
    assert np.allclose(x[0, : quality.DIMS], vectors[bucket[:3]].mean(0), atol=1e-5)
    assert np.allclose(x[0, quality.DIMS : -1], vectors[bucket[:3]].std(0), atol=1e-5)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = (x[:, 0] + rng.normal(size=800) > 0).astype(float)
    net = quality.fit_network(x, y)
    assert abs(net.probability(x).mean() - y.mean()) < 0.08
    assert np.mean((net.probability(x) > 0.5) == y) > 0.7


def test_odd_rows(spark, ws, odd, none):
    marks = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality.score(odd, marks)
    assert got.count() == odd.count() and got.where("score is null or predicted is null or held_out is null").count() == 0
    assert quality.score(none, marks).count() == 0
    kept = quality.accepted(odd, marks, threshold=0.0)
    assert kept.schema == odd.schema and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert quality.accepted(none, marks).count() == 0
    assert quality.score(odd, marks.limit(0)).where("abs(score - 0.5) > 1e-9").count() == 0


def test_repeated_labelled_rows_are_bounded(spark, monkeypatch):
    seen = []
    real = quality.fit_network
    monkeypatch.setattr(quality, "fit_network", lambda x, y: seen.append(len(y)) or real(x, y))
    docs = spark.range(400).selectExpr("id % 4 as doc_id", "concat('some words of text ', id) as text").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    quality.fit(docs, labels, max_labelled=50)
    assert seen == [50]
