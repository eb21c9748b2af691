"""Evaluation: split, train on one part, report on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.operators import evaluation as ev
from belegwerk.operators.bayes import NotEnoughData, best_class, fit
from belegwerk.operators.features import text_slices
from belegwerk.workspace import Workspace


def split_corpus(ws: Workspace, corpus: DataFrame) -> DataFrame:
    """Staged ``doc_id, label, is_test`` of the labels with enough samples; refuses too little data."""
    sizes = ev.label_sizes(ws, corpus)
    reason = ev.data_guard(sizes).first().reason
    if reason:
        raise NotEnoughData(reason)
    kept_sizes = sizes.where(F.col("n_docs") >= ev.MIN_SAMPLES)
    kept = ev.drop_small_classes(ws, corpus, sizes)
    return ws.stage(ev.split(ws, kept, kept_sizes), "split")


def evaluate(ws: Workspace, corpus: DataFrame) -> DataFrame:
    """Classification report of a staged corpus ``doc_id, label, norm``.

    Where there is too little data, the one row has the kind ``refused`` and the reason as label.
    """
    try:
        parts = split_corpus(ws, corpus)
        both = ws.stage(corpus.join(parts.select("doc_id", "is_test"), "doc_id"), "parts", slices=text_slices(corpus))
        model = fit(ws, both.where("not is_test").select("doc_id", "label", "norm"))
    except NotEnoughData as refusal:
        # Without Python workers; a fit refuses where no term is left for the vocabulary.
        refused = corpus.sparkSession.range(1).select(
            F.lit(str(refusal)).alias("label"),
            F.lit("refused").alias("kind"),
            *[F.lit(None).cast("double").alias(m) for m in ("precision", "recall", "f1_score")],
            F.lit(0).cast("long").alias("support"),
        )
        return refused
    test = both.where("is_test")
    guesses = best_class(model, test.select("doc_id", "norm"))
    pairs = test.join(guesses, "doc_id").select(
        F.col("label").alias("truth"), F.col("subfolder").alias("predicted")
    )
    return ev.class_report(ws, pairs)
