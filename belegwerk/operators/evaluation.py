"""Data checks, a stratified split and a classification report."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.operators.joins import lookup_join
from belegwerk.operators.ranking import numbered
from belegwerk.workspace import Workspace

MIN_SAMPLES = 2
REPORT_SCHEMA = (
    "label string, kind string, precision double, recall double, f1_score double, support long"
)


def label_sizes(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Staged ``label, n_docs``."""
    return ws.stage(docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs")), "sizes")


def drop_small_classes(
    ws: Workspace, docs: DataFrame, sizes: DataFrame, min_samples: int = MIN_SAMPLES
) -> DataFrame:
    """Documents whose label has at least ``min_samples`` documents."""
    kept = sizes.where(F.col("n_docs") >= min_samples).select("label")
    return lookup_join(docs, kept, "label", "left_semi")


def excluded_classes(sizes: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    return sizes.where(F.col("n_docs") < min_samples).select("label")


def data_guard(sizes: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row: what there is, and the reason to refuse training or testing (null if there is none)."""
    big = F.col("n_docs") >= min_samples
    total = sizes.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.count(F.lit(1)).alias("n_labels"),
        F.coalesce(F.sum(F.when(big, F.col("n_docs"))), F.lit(0)).alias("n_kept"),
        F.count(F.when(big, 1)).alias("n_kept_labels"),
    )
    # Of the kept documents, a fifth rounded up is for testing; each class needs one of them.
    n_test = F.ceil(F.col("n_kept") * settings.TEST_SHARE)
    reason = (
        F.when(F.col("n_docs") == 0, "no training data")
        .when(F.col("n_labels") < 2, "fewer than two labels")
        .when(F.col("n_kept_labels") < 2, "fewer than two labels with enough samples")
        .when(n_test < F.col("n_kept_labels"), "test part smaller than the number of labels")
    )
    return total.withColumn("reason", reason)


def test_quota(ws: Workspace, sizes: DataFrame, share: float = settings.TEST_SHARE) -> DataFrame:
    """``label, n_docs, n_test``: a share rounded up over all, spread over the labels in proportion.

    Whole parts go first; what is left goes to the largest remainders, equal ones by label.
    """
    total = sizes.agg(F.sum("n_docs")).first()[0] or 0
    total_test = math.ceil(total * share)
    # An integer remainder: no rounding can change the order.
    parts = sizes.withColumn("whole", F.expr(f"{total_test} * n_docs div {total or 1}")).withColumn(
        "minus", -((F.lit(total_test) * F.col("n_docs")) % F.lit(total or 1))
    )
    left = total_test - (parts.agg(F.sum("whole")).first()[0] or 0)
    ranked = numbered(ws, parts, [], ["minus", "label"], "turn")
    n_test = F.col("whole") + (F.col("turn") <= left).cast("long")
    return ranked.select("label", "n_docs", n_test.alias("n_test"))


def split(
    ws: Workspace, docs: DataFrame, sizes: DataFrame, seed: int = settings.SPLIT_SEED
) -> DataFrame:
    """``doc_id, label, is_test``: within each label the first ``n_test`` by a seeded hash are for testing."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    keyed = docs.select("doc_id", "label", key.alias("draw"))
    drawn = numbered(ws, keyed, ["label"], ["draw", "doc_id"], "place")
    quota = ws.stage(test_quota(ws, sizes).select("label", "n_test"), "quota")
    return lookup_join(drawn, quota, "label").select(
        "doc_id", "label", (F.col("place") <= F.col("n_test")).alias("is_test")
    )


def class_report(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """Rows ``label, kind, precision, recall, f1_score, support`` from ``truth, predicted``.

    ``kind`` is ``class``, ``accuracy``, ``macro avg`` or ``weighted avg``. Every label of truth or
    prediction has a row, and a zero denominator gives 0.
    """
    hit = (F.col("truth") == F.col("predicted")).cast("long")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("h")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("h")),
    )
    counts = (
        pairs.select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("n_predicted"), F.sum("h").alias("hits"))
    )

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    precision = ratio(F.col("hits"), F.col("n_predicted"))
    recall = ratio(F.col("hits"), F.col("support"))
    classes = ws.stage(
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1_score", ratio(2 * F.col("hits"), F.col("support") + F.col("n_predicted"))),
        "report",
    )
    metrics = ["precision", "recall", "f1_score"]
    total = F.sum("support").alias("support")
    accuracy = F.sum("hits") / F.sum("support")
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics]
    parts = [
        classes.select("label", F.lit("class").alias("kind"), *metrics, "support"),
        classes.agg(*[accuracy.alias(m) for m in metrics], total).withColumn("kind", F.lit("accuracy")),
        classes.agg(*[F.avg(m).alias(m) for m in metrics], total).withColumn("kind", F.lit("macro avg")),
        classes.agg(*weighted, total).withColumn("kind", F.lit("weighted avg")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.withColumn("label", F.lit("")).select(*out.columns))
    return out
