"""Multinomial naive Bayes as tables: fit, score, inspect."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.operators.features import (
    doc_freq,
    long_vectors,
    row_slices,
    term_freq,
    text_vectors,
    top_vocabulary,
    vectors,
)
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace

# Weights of a block of classes, and of one row of it.
SCORE_ROWS = 2_000_000
SLICE_ROWS = 32_768
# Documents that meet a block in one task, and the entries of their vectors; cells of the score table and entries that
# stand in memory at a time.
SCORE_DOCS = 50_000
SCORE_ENTRIES = 4_000_000
SCORE_CELLS = 1 << 22
STEP_ENTRIES = 1 << 20


@dataclass(frozen=True)
class Model:
    """Tables of a fitted classifier.

    ``vocab(term, df, cf, idf, term_id)``, ``classes(label, label_id, n_docs, log_prior,
    log_unseen)`` and ``weights(label_id, term_id, log_prob, gain)``. Pairs of class and term that
    never met are not stored; their weight is the ``log_unseen`` of the class, and ``gain`` is what a
    stored one adds to that. ``matrix`` has the gains once more for scoring, see ``weight_matrix``.
    """

    vocab: DataFrame
    classes: DataFrame
    weights: DataFrame
    matrix: DataFrame


class NotEnoughData(ValueError):
    """Training or testing was refused; the message says why."""


def label_table(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Staged ``label, n_docs, label_id``; ids follow label order."""
    counts = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    ids = (
        counts.repartitionByRange("label")
        .sortWithinPartitions("label")
        .withColumn("label_id", F.monotonically_increasing_id())
    )
    return ws.stage(ids, "labels")


def class_priors(labels: DataFrame, n_docs: int) -> DataFrame:
    return labels.withColumn("log_prior", F.log(F.col("n_docs") / F.lit(float(n_docs))))


def class_weights(
    ws: Workspace, labels: DataFrame, rows: DataFrame, n_docs: int, n_terms: int, alpha: float, slices: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Class table and sparse class-term weights from ``vectors`` that keep ``label_id``; ``slices`` as in ``stage``."""
    sums = ws.stage(
        long_vectors(rows, ("label_id",))
        .groupBy("label_id", "term_id")
        .agg(F.sum("tfidf").alias("mass")),
        "mass",
        slices=slices,
    )
    totals = sums.groupBy("label_id").agg(F.sum("mass").alias("total"))
    log_total = F.log(F.coalesce("total", F.lit(0.0)) + alpha * n_terms)
    classes = ws.stage(
        class_priors(labels, n_docs)
        .join(totals, "label_id", "left")
        .withColumn("log_total", log_total)
        .withColumn("log_unseen", F.log(F.lit(alpha)) - F.col("log_total"))
        .drop("total"),
        "classes",
    )
    met = F.log(F.col("mass") + alpha)
    weights = lookup_join(sums, classes.select("label_id", "log_total"), "label_id").select(
        "label_id",
        "term_id",
        (met - F.col("log_total")).alias("log_prob"),
        (met - F.log(F.lit(alpha))).alias("gain"),
    )
    return classes.drop("log_total"), ws.stage(weights, "weights")


def fit(
    ws: Workspace,
    docs: DataFrame,
    min_df: int = settings.MIN_DF,
    max_df: float = settings.MAX_DF,
    max_terms: int = settings.MAX_TERMS,
    alpha: float = settings.ALPHA,
) -> Model:
    """Fit on ``doc_id, label, norm``."""
    labels = label_table(ws, docs)
    n_docs = labels.agg(F.sum("n_docs")).first()[0] or 0
    if not n_docs:
        raise NotEnoughData("no training data")
    tagged = lookup_join(docs, labels.select("label", "label_id"), "label")
    tf = ws.stage(term_freq(tagged, ("label_id",)), "tf")
    freqs = doc_freq(tf, n_docs, min_df, max_df)
    return fit_counts(ws, labels, tf, freqs, n_docs, max_terms, alpha, row_slices(tf.count()))


def fit_counts(
    ws: Workspace,
    labels: DataFrame,
    tf: DataFrame,
    freqs: DataFrame,
    n_docs: int,
    max_terms: int,
    alpha: float,
    slices: int = 0,
) -> Model:
    """Fit on ``doc_id, label_id, term, tf`` and the frequencies of the terms that may be used.

    ``slices`` is the number of tasks that count the frequencies, where they are still to be counted.
    """
    return fit_vectors(ws, labels, lambda vocab: vectors(tf, vocab, ("label_id",)), freqs, n_docs, max_terms, alpha, slices)


def fit_vectors(
    ws: Workspace,
    labels: DataFrame,
    rows_of: Callable[[DataFrame], DataFrame],
    freqs: DataFrame,
    n_docs: int,
    max_terms: int,
    alpha: float,
    slices: int = 0,
) -> Model:
    """``fit_counts`` with a function that gives the documents' ``vectors``, which keep ``label_id``, for a vocabulary."""
    vocab = top_vocabulary(ws, freqs, n_docs, max_terms, slices)
    n_terms, entries = vocab.agg(F.count(F.lit(1)), F.sum("df")).first()
    if not n_terms:
        raise NotEnoughData("no term is within the frequency limits")
    classes, weights = class_weights(ws, labels, rows_of(vocab), n_docs, n_terms, alpha, row_slices(entries))
    return Model(vocab, classes, weights, ws.stage(weight_matrix(classes, weights), "matrix"))


def weight_matrix(classes: DataFrame, weights: DataFrame, limit: int = SCORE_ROWS) -> DataFrame:
    """``block, label_ids, term_ids, gains, log_prior, log_unseen``: the weights as a sparse matrix in blocks of classes.

    A block has about ``limit`` weights; a class has one per term at most and is whole in its block. Each row
    is a slice of a block by term, with its entries side by side; one more row a block has the constants of
    its classes. So a block is some dozens of rows, which are cheap to hand to every task that scores.
    """
    n = weights.count()
    blocks = max(1, -(-n // limit))
    slices = max(1, -(-n // (blocks * SLICE_ROWS)))
    block = F.pmod(F.xxhash64("label_id"), F.lit(blocks)).cast("int").alias("block")
    of_block = F.collect_list(F.struct("label_id", "log_prior", "log_unseen")).alias("c")
    constants = classes.groupBy(block).agg(of_block)
    none = F.array().cast("array<double>")
    entries = weights.groupBy(block, F.pmod(F.xxhash64("term_id"), F.lit(slices)).alias("slice"))
    entries = entries.agg(F.collect_list(F.struct("label_id", "term_id", "gain")).alias("e"))
    entries = entries.select("block", F.col("e.label_id").alias("label_ids"), F.col("e.term_id").alias("term_ids"), F.col("e.gain").alias("gains"), none.alias("log_prior"), none.alias("log_unseen"))
    return entries.unionByName(
        constants.select("block", F.col("c.label_id").alias("label_ids"), F.array().cast("array<long>").alias("term_ids"), none.alias("gains"), F.col("c.log_prior").alias("log_prior"), F.col("c.log_unseen").alias("log_unseen"))
    )


@dataclass(frozen=True)
class _Block:
    """Some classes of a model as arrays: gains by term, and what every document gets."""

    labels: np.ndarray
    log_prior: np.ndarray
    log_unseen: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    gains: np.ndarray

    def scores(self, doc: np.ndarray, term: np.ndarray, tfidf: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Joint log likelihoods, documents by classes, of entries ``doc, term, tfidf``."""
        n = len(self.labels)
        out = self.log_prior + mass[:, None] * self.log_unseen
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        known = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        doc, at, tfidf = doc[known], at[known], tfidf[known]
        counts = self.starts[at + 1] - self.starts[at]
        # The entries of a few documents at a time: an entry meets every class that has its term.
        for low, high in _slices(counts, 1 << 20):
            c = counts[low:high]
            ends = np.cumsum(c)
            spot = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at[low:high]] - ends + c, c)
            first = doc[low] if high > low else 0
            cell = (np.repeat(doc[low:high], c) - first) * n + self.places[spot]
            added = np.bincount(cell, weights=np.repeat(tfidf[low:high], c) * self.gains[spot])
            out.reshape(-1)[first * n : first * n + len(added)] += added
        return out


def _slices(counts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of entries with about ``size`` in sum."""
    sums = np.concatenate(([0], np.cumsum(counts)))
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(sums, sums[low] + size, side="right")) - 1)
        yield low, high
        low = high


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """All entries of a column of lists."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _block_of(rows: pa.Table) -> _Block:
    """The block that the rows of ``weight_matrix`` with one number make up."""
    constant = np.array([len(x) > 0 for x in rows["log_prior"]], bool)
    own, entries = rows.filter(pa.array(constant)), rows.filter(pa.array(~constant))
    labels = _joined(own["label_ids"])
    by_label = np.argsort(labels)
    labels = labels[by_label]
    term, label, gain = (_joined(entries[c]) for c in ("term_ids", "label_ids", "gains"))
    order = np.lexsort((label, term))
    terms, starts = np.unique(term[order], return_index=True)
    return _Block(
        labels,
        _joined(own["log_prior"])[by_label],
        _joined(own["log_unseen"])[by_label],
        terms,
        np.append(starts, len(term)),
        np.searchsorted(labels, label[order]),
        gain[order],
    )


def class_scores(model: Model, docs: DataFrame, k: int, score_docs: int = SCORE_DOCS) -> DataFrame:
    """One row per document of ``doc_id, norm``: ``doc_id, ranked, best, total``.

    ``ranked`` is ``array<struct<down, label_id>>`` with the negated joint log likelihoods of the ``k``
    best classes, the best one first, equal ones in label order; ``best`` is the highest likelihood and
    ``total`` the sum of all, as multiples of it.

    No row per document and class is made. The documents' vectors are dealt into blocks, and each block of
    documents meets each block of classes in one task, which gets both through a shuffle: neither weights nor
    vectors pass the driver, and a task holds a block of either, whose sizes are bounded. Each meeting leaves
    the ``k`` best classes and a sum per document, which are merged where a model has several blocks.
    """
    ws = Workspace(docs.sparkSession)
    norms = ws.stage(docs.select("doc_id", "norm"), "norms")
    rows = ws.stage(text_vectors(norms, model.vocab), "vectors")
    n_blocks = (model.matrix.agg(F.max("block")).first()[0] or 0) + 1
    n_docs, entries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    dealt = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs // score_docs), -(-entries // SCORE_ENTRIES))
    flat = rows.select(
        "doc_id",
        (F.col("mass") / F.col("norm")).alias("mass"),
        "norm",
        F.col("terms.term_id").alias("terms"),
        F.col("terms.raw").alias("raw"),
        F.pmod(F.xxhash64("doc_id"), F.lit(dealt)).cast("int").alias("part"),
    )
    flat = flat.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    matrix = model.matrix.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ranked array<struct<down: double, label_id: long>>, best double, total double"

    def run(part: pa.Table, weights: pa.Table) -> pa.Table:
        found = list(_block_scores(part, _block_of(weights), k)) if len(part) and len(weights) else []
        return pa.concat_tables(found) if found else _no_scores(part.schema.field("doc_id").type)

    keys = ("part", "block")
    flat, matrix = (side.repartition(dealt * n_blocks, *keys) for side in (flat, matrix))
    scored = flat.groupBy(*keys).cogroup(matrix.groupBy(*keys)).applyInArrow(run, schema)
    if n_blocks == 1:
        return scored
    merged = scored.groupBy("doc_id").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("ranked"))), 1, k).alias("ranked"),
        F.max("best").alias("best"),
        F.collect_list(F.struct("best", "total")).alias("sums"),
    )
    total = F.aggregate("sums", F.lit(0.0), lambda acc, s: acc + s.total * F.exp(s.best - F.col("best")))
    return merged.select("doc_id", "ranked", "best", total.alias("total"))


def _no_scores(kind: pa.DataType) -> pa.Table:
    pairs = pa.list_(pa.struct([("down", pa.float64()), ("label_id", pa.int64())]))
    return pa.schema([("doc_id", kind), ("ranked", pairs), ("best", pa.float64()), ("total", pa.float64())]).empty_table()


def _block_scores(part: pa.Table, block: _Block, k: int) -> Iterator[pa.Table]:
    """The scores of some documents at a time against the classes of a block."""
    step = max(1, SCORE_CELLS // max(1, len(block.labels)))
    entries = pc.list_value_length(part["terms"]).to_numpy()
    cuts = [(at + low, at + high) for at in range(0, len(part), step) for low, high in _slices(entries[at : at + step], STEP_ENTRIES)]
    for low, high in cuts:
        batch = part.slice(low, high - low).combine_chunks()
        terms = batch["terms"].combine_chunks()
        doc = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
        norm = batch["norm"].to_numpy()
        tfidf = _joined(batch["raw"]) / norm[doc]
        scores = block.scores(doc, terms.flatten().to_numpy(), tfidf, batch["mass"].to_numpy())
        # Scores that differ by rounding noise only count as equal.
        down = -np.round(scores, 9)
        top = np.argsort(down, axis=1, kind="stable")[:, :k]
        best = -down.min(axis=1)
        total = np.exp(-down - best[:, None]).sum(axis=1)
        pairs = pa.StructArray.from_arrays(
            [pa.array(np.take_along_axis(down, top, 1).ravel()), pa.array(block.labels[top].ravel())], ["down", "label_id"]
        )
        ranked = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * top.shape[1], pairs)
        yield pa.Table.from_arrays([batch["doc_id"], ranked, pa.array(best), pa.array(total)], ["doc_id", "ranked", "best", "total"])


def top_classes(model: Model, docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, rank, label, p`` of the ``k`` best classes; ``p`` is the softmax over all classes."""
    rows = (
        class_scores(model, docs, k)
        .select("doc_id", "best", "total", F.posexplode("ranked").alias("pos", "c"))
        .select(
            "doc_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("c.label_id").alias("label_id"),
            (F.exp(-F.col("c.down") - F.col("best")) / F.col("total")).alias("p"),
        )
    )
    names = model.classes.select("label_id", "label")
    return lookup_join(rows, names, "label_id").select("doc_id", "rank", "label", "p")


def best_class(model: Model, docs: DataFrame) -> DataFrame:
    """``doc_id, subfolder, confidence`` of the best class."""
    return top_classes(model, docs, 1).select(
        "doc_id", F.col("label").alias("subfolder"), F.col("p").alias("confidence")
    )


def classify(model: Model, docs: DataFrame) -> DataFrame:
    """Add ``subfolder`` and ``confidence`` to rows with ``doc_id, text, norm``.

    An empty text is not classified: subfolder empty, confidence 0.
    """
    has_text = F.length(F.coalesce("text", F.lit(""))) > 0
    best = best_class(model, docs.where(has_text).select("doc_id", "norm"))
    return docs.join(best, "doc_id", "left").withColumns(
        {
            "subfolder": F.coalesce("subfolder", F.lit("")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
        }
    )


def top_terms(model: Model, terms: int = 10, classes: int = 20) -> DataFrame:
    """``label, rank, term, log_prob`` of the strongest terms of the first classes by name.

    Where a class has met fewer terms than asked for, unseen ones fill up in term order.
    """
    first = model.classes.orderBy("label_id").limit(classes).select("label_id", "label", "log_unseen")
    first = F.broadcast(first)  # at most ``classes`` rows
    met = model.weights.drop("gain").join(first.select("label_id", "label"), "label_id")
    # The first ``terms`` terms are enough to fill up from: as many as a class lacks are unseen in it.
    opening = model.vocab.orderBy("term_id").limit(terms)
    opening = opening.agg(F.collect_list("term_id").alias("ids")).select("ids").scalar()
    unseen = (
        first.select("label_id", "label", F.explode(opening).alias("term_id"), F.col("log_unseen").alias("log_prob"))
        .join(model.weights.select("label_id", "term_id"), ["label_id", "term_id"], "left_anti")
        .select(*met.columns)
    )
    by_weight = Window.partitionBy("label_id").orderBy(F.desc(F.round("log_prob", 9)), "term_id")
    best = (
        met.unionByName(unseen)
        .withColumn("rank", F.row_number().over(by_weight))
        .where(F.col("rank") <= terms)
    )
    return lookup_join(best, model.vocab.select("term_id", "term"), "term_id").select(
        "label", "rank", "term", "log_prob"
    )


def model_summary(model: Model) -> DataFrame:
    """One row: number of classes and of vocabulary terms."""
    n_terms = model.vocab.agg(F.count(F.lit(1)).alias("n"))
    return model.classes.agg(F.count(F.lit(1)).alias("n_classes")).select(
        "n_classes", n_terms.select("n").scalar().alias("n_terms")
    )
