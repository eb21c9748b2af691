"""Routing, manifests, promotion of reviewed files and folder upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.functions.paths import file_name, join_path, local_path, parent, relative_to
from belegwerk.operators.naming import resolve_names
from belegwerk.workspace import Workspace

BUCKETS = ("Inbox", "Review", "Unsure")
Existing = DataFrame | Callable[[DataFrame], DataFrame]


class PromotionConflict(RuntimeError):
    """Some targets exist already; nothing was written."""


def route(confidence: Column | str, threshold: float = settings.REVIEW_THRESHOLD) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c >= threshold, F.lit("Review")).otherwise(F.lit("Unsure"))


def manifest(ws: Workspace, docs: DataFrame, existing: Existing, mode: str) -> DataFrame:
    """``doc_id, src, dst, bucket, subfolder, action`` of ``doc_id, path, bucket, root, subfolder, name``.

    MOVE and COPY take a free name. NO_CHANGE only reports the wanted target. ``existing`` are the names
    already there, ``folder, name``, or a function that finds those among them that wanted ones can meet.
    """
    rows = docs.withColumn("folder", join_path("root", "subfolder"))
    if mode == "NO_CHANGE":
        named = rows.withColumn("final_name", F.col("name"))
    else:
        if callable(existing):
            rows = ws.stage(rows, "named")
            existing = existing(rows.select("folder", "name"))
        named = resolve_names(ws, rows, existing)
    return named.select(
        "doc_id",
        F.col("path").alias("src"),
        join_path("folder", "final_name").alias("dst"),
        "bucket",
        "subfolder",
        F.lit(mode).alias("action"),
    )


def is_tax_name(name: Column) -> Column:
    """Whether the input file's own name speaks of tax, in any case."""
    words = F.array(*[F.lit(w) for w in settings.TAX_WORDS])
    return F.exists(words, lambda w: F.contains(F.lower(name), w))


def tax_copies(rows: DataFrame, review_root: str) -> DataFrame:
    """One more manifest row per tax file, in a fixed folder; of equal names the last one stays.

    MOVE and COPY both copy the file that was filed. NO_CHANGE copies nothing.
    """
    target = F.concat(F.lit(f"{review_root}/{settings.TAX_FOLDER}/"), file_name("dst"))
    wanted = rows.where(is_tax_name(file_name("src"))).where("action <> 'NO_CHANGE'")
    return (
        wanted.select("doc_id", F.struct("doc_id", F.col("dst").alias("src")).alias("last"), target.alias("dst"))
        .groupBy("dst")
        .agg(F.max("last").alias("last"))
        .select(
            "last.doc_id",
            "last.src",
            "dst",
            F.lit("Review").alias("bucket"),
            F.lit(settings.TAX_FOLDER).alias("subfolder"),
            F.lit("COPY").alias("action"),
        )
    )


def manifest_view(rows: DataFrame, base: str) -> DataFrame:
    """``source, target``: file name and target below ``base``, or the full target if it lies elsewhere."""
    return rows.select(
        "doc_id",
        file_name("src").alias("source"),
        F.coalesce(relative_to("dst", base), F.col("dst")).alias("target"),
    )


def write_manifest(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy("bucket").parquet(path)


def promotion_plan(review: DataFrame, review_root: str, dest_root: str) -> DataFrame:
    """``src, dst`` with the same relative path below the destination; a null ``dst`` for files elsewhere."""
    inside = relative_to("path", review_root)
    target = F.when(inside.isNotNull(), join_path(F.lit(dest_root.rstrip("/")), inside))
    return review.select(F.col("path").alias("src"), target.alias("dst"))


def promotion_conflicts(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned rows whose target is there already; ``existing`` has ``path``, with a scheme or not."""
    taken = existing.select(local_path("path").alias("_taken")).distinct()
    return plan.join(taken, local_path("dst") == F.col("_taken"), "left_semi")


def promote(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """The plan, after a check that every row has a target of its own that does not exist.

    All targets are checked before any is used.
    """
    lost = plan.where("dst is null").select("src").take(1)
    if lost:
        raise PromotionConflict(f"not below the review folder: {lost[0].src}")
    clash = promotion_conflicts(plan, existing).select("dst").take(1)
    if clash:
        raise PromotionConflict(f"destination exists: {clash[0].dst}")
    double = plan.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if double:
        raise PromotionConflict(f"two files for one destination: {double[0].dst}")
    return plan


def move_summary(outcome: DataFrame) -> DataFrame:
    """``moved, total`` of rows with a ``status``."""
    return outcome.agg(
        F.count_if(F.col("status") == "moved").alias("moved"), F.count(F.lit(1)).alias("total")
    )


def parents_below(path: Column, root: str) -> Column:
    """All folders above a path, relative to ``root`` above them, the nearest one last."""
    parts = F.split(parent(relative_to(path, root)), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def empty_dirs(dirs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Folders below ``root`` with no file at any depth, deepest first.

    ``dirs`` and ``files`` have ``path``, with a scheme or not. File counts are summed per folder
    before the shuffle.
    """
    inside = files.where(parent(relative_to("path", root)) != "")
    filled = inside.select(F.explode(parents_below(F.col("path"), root)).alias("_below")).groupBy("_below").agg(
        F.count(F.lit(1)).alias("n_files")
    )
    below = dirs.select(F.col("path").alias("dir"), F.rtrim(relative_to("path", root), F.lit("/")).alias("_below"))
    below = below.where("_below is not null").distinct()
    return below.join(filled, "_below", "left_anti").select("dir").orderBy(F.desc("dir"))


def folder_counts(files: DataFrame) -> DataFrame:
    """``bucket, n_files`` for inbox, review and unsure; a bucket without files counts 0."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    row = files.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n_files")) for b in BUCKETS])
    return row.select(F.inline(pairs))
