"""A training corpus from ``documents``: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.llm import decontaminate, line_dedup, mixing, quality, simhash
from belegwerk.llm.common import table
from belegwerk.workspace import Workspace


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; each row is judged by its own text."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines from its texts; ``n_chars`` follows the text."""
    out = line_dedup.drop_boilerplate(Workspace(spark), docs, merge_copies=True)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest key of each near-duplicate class."""
    return simhash.representatives(Workspace(spark), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(Workspace(spark), docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: how many words of each document the mix takes."""
    return mixing.mix(Workspace(spark), docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]

# Network scores, SimHash components, tilings and knapsacks are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
