"""Terms, vocabulary and TF-IDF vectors as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.functions.text import term_words, without_stop_words, word_pairs
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace


# Characters of the texts whose terms one task counts, and rows that one task groups.
COUNT_CHARS = 4 << 20
COUNT_ROWS = 1 << 20


def text_slices(docs: DataFrame) -> int:
    """Tasks over which the texts of staged ``norm`` are spread, each with about ``COUNT_CHARS``."""
    chars = docs.agg(F.sum(F.length("norm").cast("long"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // COUNT_CHARS))


def row_slices(rows: int) -> int:
    return -(-rows // COUNT_ROWS)


def terms_of(norm: Column | str) -> Column:
    """Terms of a normalised text: words without stop words, then their neighbouring pairs."""
    tokens = without_stop_words(term_words(norm))
    # The inner array is bound once, so words are split once per row.
    return F.flatten(F.transform(F.array(tokens), lambda t: F.concat(t, word_pairs(t))))


def term_freq(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``doc_id, *keep, term, tf`` from ``doc_id, *keep, norm``.

    Documents are spread by ``doc_id`` while they are one row each, over as many tasks as their measured
    length asks for (``docs`` is staged). The exploded terms, several times that size, are then counted in
    place. A document without terms stays as one row with a null term and ``tf`` 0.
    """
    return _exploded(docs, keep).groupBy("doc_id", *keep, "term").agg(F.count("term").alias("tf"))


def _exploded(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    spread = docs.select("doc_id", *keep, "norm").repartition(text_slices(docs), "doc_id")
    return spread.select("doc_id", *keep, F.explode_outer(terms_of("norm")).alias("term"))


def doc_freq(
    tf: DataFrame, n_docs: int, min_df: int = settings.MIN_DF, max_df: float = settings.MAX_DF
) -> DataFrame:
    """``term, df, cf`` of the terms that are neither too rare nor too common."""
    freqs = tf.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return within_limits(freqs, n_docs, min_df, max_df)


def within_limits(freqs: DataFrame, n_docs: int, min_df: int, max_df: float) -> DataFrame:
    return freqs.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))


def top_vocabulary(
    ws: Workspace, freqs: DataFrame, n_docs: int, max_terms: int = settings.MAX_TERMS, slices: int = 0
) -> DataFrame:
    """Staged ``term, df, cf, idf, term_id`` of the most frequent terms; ids follow term order.

    Sorting all terms for a limit would send ``max_terms`` rows of every partition to one task. A
    histogram over at most about a thousand count classes finds the class that holds the cut, so
    only terms down to that class are sorted. Where ``freqs`` is still to be counted, ``slices`` is the number
    of tasks for that.
    """
    freqs = ws.stage(freqs.withColumn("_class", F.floor(F.log2("cf") * 16)), "freqs", slices=slices)
    classes = freqs.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_class"))
    seen = 0
    cut = None
    for row in classes.collect():  # one row per count class, at most 16 * 63
        cut = row["_class"]
        seen += row["_n"]
        if seen >= max_terms:
            break
    picked = freqs if cut is None else freqs.where(F.col("_class") >= cut)
    picked = picked.drop("_class").orderBy(F.desc("cf"), "term").limit(max_terms)
    vocab = (
        picked.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
        .repartitionByRange("term")
        .sortWithinPartitions("term")
        .withColumn("term_id", F.monotonically_increasing_id())
    )
    return ws.stage(vocab, "vocab")


def vectors(tf: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, *keep, terms array<struct<term_id, raw>>, mass, norm``.

    ``raw`` is count times idf, ``mass`` its sum and ``norm`` its length. Unknown terms drop out; a
    document without known terms keeps an empty array, mass 0 and norm 1.
    """
    return _gathered(lookup_join(tf, vocab.select("term", "term_id", "idf"), "term", "left"), keep)


def known_vectors(tf: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``vectors`` without documents that have no known term; unknown terms go before anything is shuffled."""
    return _gathered(lookup_join(tf, vocab.select("term", "term_id", "idf"), "term"), keep)


def text_vectors(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``vectors(term_freq(docs), vocab)`` of staged ``doc_id, norm``; unknown terms go before anything is counted."""
    known = lookup_join(_exploded(docs, ()), vocab.select("term", "term_id", "idf"), "term", "left")
    return _gathered(known.groupBy("doc_id", "term_id", "idf").agg(F.count("term_id").alias("tf")), ())


def _gathered(known: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    raw = F.col("tf") * F.col("idf")
    known = known.select("doc_id", *keep, "term_id", raw.alias("raw"))
    entry = F.when(F.col("term_id").isNotNull(), F.struct("term_id", "raw"))
    return known.groupBy("doc_id", *keep).agg(
        F.collect_list(entry).alias("terms"),
        F.coalesce(F.sum("raw"), F.lit(0.0)).alias("mass"),
        F.coalesce(F.sqrt(F.sum(F.col("raw") * F.col("raw"))), F.lit(1.0)).alias("norm"),
    )


def long_vectors(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form ``*keep, term_id, tfidf`` of ``vectors``, weights of length one per document."""
    # The division stays outside the array, where the norm is read once per row.
    return rows.select(*keep, "norm", F.inline("terms")).select(
        *keep, "term_id", (F.col("raw") / F.col("norm")).alias("tfidf")
    )


def tfidf_rows(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """Long form ``doc_id, term, tfidf``."""
    long = long_vectors(vectors(tf, vocab), ("doc_id",))
    return lookup_join(long, vocab.select("term_id", "term"), "term_id").select(
        "doc_id", "term", "tfidf"
    )
