"""The term store against full fits, over several states of a corpus."""

import random

import pytest
from pyspark.sql import functions as F

from belegwerk.operators import bayes, term_store
from belegwerk.operators.term_store import TermStore
from belegwerk.plans import training

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def state(seed, n=60):
    """Documents of which some change their text, their folder or are gone from one seed to the next."""
    rows = []
    for i in range(n):
        rng = random.Random(i if i % 10 else f"{i} {seed}")
        if i % 10 == 0 and rng.random() < 0.4:
            continue
        folder = "a" if (i + (seed if i % 7 == 0 else 0)) % 2 else "b"
        text = " ".join(rng.choices(WORDS, k=rng.choice([1, 30, 60])))
        rows.append((i, f"/root/{folder}/{i}.pdf", text))
    return rows


def table(model):
    labels = model.classes.select("label", "label_id", F.round("log_prior", 9), F.round("log_unseen", 9))
    rows = model.weights.join(labels, "label_id").join(model.vocab.select("term", "term_id", "df", "cf"), "term_id")
    return sorted(tuple(r) for r in rows.drop("label_id", "term_id").withColumns({c: F.round(c, 9) for c in ("log_prob", "gain")}).collect())


@pytest.mark.parametrize("most", [2, 16])
def test_equals_a_full_fit_and_reads_changes_only(spark, ws, monkeypatch, most):
    monkeypatch.setattr(term_store, "MOST_PARTS", most)
    path = ws.path("store")
    before = {}
    for seed in range(4):
        rows = state(seed)
        docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
        corpus = training.labelled_corpus(docs, "/root")
        asked = []

        def read(new):
            asked.extend(r.doc_id for r in new.collect())
            return docs.join(new, "doc_id").select("doc_id", F.col("text").alias("norm"))

        store = TermStore(spark, path).advance(ws, corpus.drop("text"), read)
        now = {i: text for i, _, text in rows}
        assert sorted(asked) == sorted(i for i, text in now.items() if before.get(i) != text)
        assert len(store.version.parts) <= most
        before = now
        full = corpus.select("doc_id", "label", F.col("text").alias("norm")).join(store.docs.where("kept").select("doc_id"), "doc_id")
        assert table(store.fit(ws)) == table(bayes.fit(ws, full))


def test_a_lost_race_changes_nothing(spark, ws):
    path = ws.path("store")
    docs = spark.createDataFrame(state(0), "doc_id long, path string, text string")
    files = training.labelled_corpus(docs, "/root").drop("text")
    late = TermStore(spark, path)

    def read(new):
        return docs.join(new, "doc_id").select("doc_id", F.col("text").alias("norm"))

    first = TermStore(spark, path).advance(ws, files, read)
    with pytest.raises(Exception, match="exists"):
        late.advance(ws, files.limit(3), read)
    assert TermStore(spark, path).version == first.version


def test_an_empty_corpus_and_an_unread_text(spark, ws):
    none = spark.createDataFrame([], "doc_id long, label string, content_hash string")
    store = TermStore(spark, ws.path("store")).advance(ws, none, lambda new: new.select("doc_id", F.lit("").alias("norm")))
    with pytest.raises(bayes.NotEnoughData):
        store.fit(ws)
    some = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], none.schema)
    unread = store.advance(ws, some, lambda new: new.where("doc_id = 1").select("doc_id", F.lit("").alias("norm")))
    assert [(r.doc_id, r.kept) for r in unread.docs.collect()] == [(1, False)]
    asked = []
    unread.advance(ws, some, lambda new: asked.extend(r.doc_id for r in new.collect()) or new.select("doc_id", F.lit("").alias("norm")))
    assert asked == [2]


def test_texts_do_not_stay_and_the_fit_shuffles_known_terms(spark, ws, monkeypatch):
    """The disk of a training holds its texts until they are counted; a fit moves vectors, not lists of all terms."""
    from pathlib import Path

    from belegwerk.operators.joins import lookup_join

    docs = spark.createDataFrame(state(0), "doc_id long, path string, text string")
    path = ws.path("store")
    joined = []
    inner = TermStore.terms_of
    monkeypatch.setattr(TermStore, "terms_of", lambda self, rows: joined.append(rows) or inner(self, rows))
    model = training.train_changes(ws, docs, "/root", path)
    assert not joined
    kept = {p.parent.name for p in Path(ws.root).rglob("part-*.parquet") if "norm" in spark.read.parquet(str(p)).columns}
    assert not kept
    # Repeated keys take the way by all terms, as their rows make up one vector.
    training.train_changes(ws, docs.unionByName(docs), "/root", ws.path("twice"))
    assert joined
    # A document without any known term has no weights, but counts for its label.
    store = TermStore(spark, path)
    assert model.classes.agg(F.sum("n_docs")).first()[0] == store.docs.where("kept").count()
    assert lookup_join(model.weights, model.classes.select("label_id", "label"), "label_id").count() == model.weights.count()
