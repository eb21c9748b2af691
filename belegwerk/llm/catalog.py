"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.llm import (
    cover_tree,
    decontaminate,
    jaccard_join,
    licenses,
    line_dedup,
    mixing,
    ppm,
    prefix_trie,
    quality,
    simhash,
    suffixes,
    vector_codes,
    wrappers,
)
from belegwerk.llm.common import table
from belegwerk.workspace import Workspace


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, contaminated, item_id, coverage, n_items`` of all documents."""
    return decontaminate.leaks(Workspace(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(Workspace(spark), table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(Workspace(spark), table(spark, sf_dir, "pages"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(Workspace(spark), table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(Workspace(spark), table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id", "n_same")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(Workspace(spark), table(spark, sf_dir, "documents"), merge_copies=True)
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.search(Workspace(spark), table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(Workspace(spark), table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(Workspace(spark), table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(Workspace(spark), table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(Workspace(spark), table(spark, sf_dir, "conversations"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(Workspace(spark), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_mix,
        op3_quality,
        op4_wrappers,
        op5_ppm,
        op6_simhash,
        op7_line_dedup,
        op8_top_k,
        op9_repeats,
        op10_licenses,
        op11_vector_codes,
        op12_prefix_trie,
        op13_jaccard_join,
    )
}

ORACLES = {
    "op7_line_dedup": line_dedup.SQL,
    "op8_top_k": cover_tree.SQL,
    "op10_licenses": licenses.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
