"""Classifier against a plain computation, and the joins on their shuffled way."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from belegwerk.operators import bayes, evaluation, features, joins
from belegwerk.plans.evaluate import evaluate
from belegwerk.sources.model_store import ModelMissing, load_model, save_model
from belegwerk.workspace import shuffled_in

DOCS = [
    (1, "a", "alpha beta beta gamma"),
    (2, "a", "alpha beta delta"),
    (3, "b", "gamma delta epsilon"),
    (4, "b", "delta epsilon epsilon alpha"),
    (5, "c", "zeta"),
    (6, "b", "epsilon gamma"),
]


def terms(norm):
    words = norm.split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_scores(docs, alpha=0.01):
    n = len(docs)
    tf = {d: Counter(terms(t)) for d, _, t in docs}
    df = Counter(t for c in tf.values() for t in c)
    vocab = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items() if 2 <= k <= 0.9 * n}
    vec = {}
    for d, c in tf.items():
        raw = {t: k * vocab[t] for t, k in c.items() if t in vocab}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        vec[d] = {t: x / norm for t, x in raw.items()}
    mass = defaultdict(Counter)
    for d, label, _ in docs:
        mass[label].update(vec[d])
    size = Counter(label for _, label, _ in docs)
    out = {}
    for d in vec:
        joint = {}
        for label in size:
            total = sum(mass[label].values()) + alpha * len(vocab)
            joint[label] = math.log(size[label] / n) + sum(
                w * math.log((mass[label][t] + alpha) / total) for t, w in vec[d].items()
            )
        top = max(joint.values())
        z = sum(math.exp(v - top) for v in joint.values())
        out[d] = {label: math.exp(v - top) / z for label, v in joint.items()}
    return out


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, label string, norm string")


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, -1])
def test_probabilities(spark, ws, docs, limit, monkeypatch):
    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", limit))
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    if limit < 0:
        # Several blocks of classes, slices of a block and blocks of documents.
        monkeypatch.setattr(bayes.weight_matrix, "__defaults__", (5,))
        monkeypatch.setattr(bayes, "SLICE_ROWS", 2)
        monkeypatch.setattr(bayes, "SCORE_CELLS", 2)
        monkeypatch.setattr(bayes.class_scores, "__defaults__", (2,))
    model = bayes.fit(ws, docs)
    got = defaultdict(dict)
    for r in bayes.top_classes(model, docs.select("doc_id", "norm"), 3).collect():
        got[r.doc_id][r.label] = r.p
    want = plain_scores(DOCS)
    for d in want:
        assert got[d] == pytest.approx(want[d])
    # A text without known terms gets the priors.
    assert got[5] == pytest.approx({"a": 2 / 6, "b": 3 / 6, "c": 1 / 6})


def test_empty_text_is_not_classified(spark, ws, docs):
    model = bayes.fit(ws, docs)
    new = spark.createDataFrame([(9, "", ""), (10, "x", "alpha beta")], "doc_id long, text string, norm string")
    rows = {r.doc_id: r for r in bayes.classify(model, new).collect()}
    assert (rows[9].subfolder, rows[9].confidence) == ("", 0.0)
    assert rows[10].subfolder == "a"


def test_scoring_stays_off_the_driver(spark, ws, docs, monkeypatch):
    """Documents and weights meet through one shuffle of either; no row per document and class, nothing collected."""
    model = bayes.fit(ws, docs)
    assert model.matrix.count() == 2
    collected = []
    for name in ("toPandas", "toArrow", "collect", "toLocalIterator"):
        real = getattr(type(docs), name)
        monkeypatch.setattr(type(docs), name, lambda self, *a, real=real, **b: collected.append(self.columns) or real(self, *a, **b))
    rows = bayes.class_scores(model, docs.select("doc_id", "norm"), 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan
    assert all(c not in (["label_id", "term_id", "gain"], model.weights.columns, model.matrix.columns) for c in collected)
    assert rows.count() == docs.select("doc_id").distinct().count()


def test_model_store(spark, ws, docs, tmp_path):
    with pytest.raises(ModelMissing):
        load_model(spark, str(tmp_path / "none"))
    save_model(bayes.fit(ws, docs), str(tmp_path / "m"))
    model = load_model(spark, str(tmp_path / "m"))
    assert bayes.model_summary(model).first().asDict() == {"n_classes": 3, "n_terms": model.vocab.count()}
    best = bayes.top_terms(model, terms=2, classes=2).orderBy("label", "rank").collect()
    assert [(r.label, r.rank) for r in best] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_top_terms_fill_up(ws, docs):
    rows = bayes.top_terms(bayes.fit(ws, docs), terms=10).where("label = 'c'").orderBy("rank").collect()
    assert [r.term for r in rows] == sorted(r.term for r in rows)
    assert len({round(r.log_prob, 9) for r in rows}) == 1


def test_no_terms_left(spark, ws):
    lone = spark.createDataFrame([(1, "a", "eins"), (2, "b", "zwei")], "doc_id long, label string, norm string")
    with pytest.raises(bayes.NotEnoughData):
        bayes.fit(ws, lone)


def test_refused_evaluation(ws, docs):
    # Label c has one document; of the other five, one is for testing, for two labels.
    row = evaluate(ws, docs).first()
    assert (row.kind, row.label) == ("refused", "test part smaller than the number of labels")


def test_quota_adds_up(spark, ws):
    sizes = spark.createDataFrame([("a", 7), ("b", 3), ("c", 5), ("d", 2)], "label string, n_docs long")
    rows = {r.label: r.n_test for r in evaluation.test_quota(ws, sizes).collect()}
    assert sum(rows.values()) == math.ceil(17 * 0.2)
    assert rows == {"a": 2, "b": 1, "c": 1, "d": 0}


def test_report(spark, ws):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "truth string, predicted string")
    rows = {(r.label, r.kind): r for r in evaluation.class_report(ws, pairs).collect()}
    assert rows["b", "class"].precision == pytest.approx(1 / 3)
    assert rows["c", "class"].f1_score == 0.0
    assert rows["", "accuracy"].recall == 0.5
    assert rows["", "macro avg"].precision == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert rows["", "weighted avg"].recall == 0.5


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    big = spark.range(600).select(
        "id", F.expr("case when id % 3 = 0 then 1 when id % 50 = 7 then null else id % 40 end").alias("k")
    )
    small = spark.createDataFrame([(1, "x"), (1, "y"), (5, "z"), (99, "w")], "k long, v string")
    got = joins.salted_join(big, small, "k", how, salts=4)
    want = big.join(small, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_tasks_follow_the_texts(spark, ws, docs, monkeypatch):
    """Terms are counted, grouped and scored over more tasks where there is more text; results stay."""
    few = bayes.fit(ws, docs)
    before = sorted(bayes.top_classes(few, docs).collect())
    for module, name in ((features, "COUNT_CHARS"), (features, "COUNT_ROWS"), (bayes, "SCORE_ENTRIES"), (bayes, "STEP_ENTRIES")):
        monkeypatch.setattr(module, name, 2)
    chars = docs.selectExpr("sum(length(norm))").first()[0]
    assert features.term_freq(docs).rdd.getNumPartitions() >= chars // 2
    at = spark.conf.get("spark.sql.shuffle.partitions")
    many = bayes.fit(ws, docs)
    entries = many.vocab.agg({"df": "sum"}).first()[0]
    scored = bayes.class_scores(many, docs, 1)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert max(int(n) for n in re.findall(r"hashpartitioning\(part#\d+, block#\d+, (\d+)\)", plan)) >= entries // 2
    assert [tuple(r[:3]) for r in sorted(bayes.top_classes(many, docs).collect())] == [tuple(r[:3]) for r in before]
    assert spark.conf.get("spark.sql.shuffle.partitions") == at


def test_shuffles_of_a_staged_step(spark, ws):
    """A step may ask for more shuffle partitions than the session has; the session keeps its own."""
    at = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    with shuffled_in(spark, int(at) + 3):
        seen.append(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffled_in(spark, 1):
        seen.append(spark.conf.get("spark.sql.shuffle.partitions"))
    assert seen == [str(int(at) + 3), at] and spark.conf.get("spark.sql.shuffle.partitions") == at
