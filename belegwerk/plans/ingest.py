"""Processing: classify, find date and subject, name, route, file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.functions.paths import is_pdf
from belegwerk.functions.text import build_name, normalize_text
from belegwerk.operators.bayes import Model, classify
from belegwerk.operators.filing import Existing, manifest, route, tax_copies
from belegwerk.operators.metadata import Extractor, extract_missing, extract_stored, fill_metadata
from belegwerk.operators.rules import apply_rules
from belegwerk.settings import JobSettings
from belegwerk.sources.files import PageReader, page_text, read_pages, scan_inbox
from belegwerk.workspace import Workspace


def understand(
    ws: Workspace,
    docs: DataFrame,
    model: Model,
    job: JobSettings,
    extractor: Callable[[], Extractor] | None = None,
    replies: str | None = None,
) -> DataFrame:
    """Staged ``doc_id, path, subfolder, confidence, date, subject`` of ``doc_id, path, text, mtime``.

    Replies come from ``extractor`` or from a column ``reply`` of the input; both may be absent. With a
    folder ``replies`` the extractor's replies are stored there, and no prompt is asked twice.
    """
    rows = docs.where(is_pdf("path")).withColumn("text", F.coalesce("text", F.lit("")))
    rows = classify(model, rows.withColumn("norm", normalize_text("text"))).drop("norm")
    rows = apply_rules(rows, job.rules, job.as_of, "subject").withColumn("date", F.lit(None).cast("date"))
    if extractor is not None and replies is not None:
        rows = extract_stored(ws, rows.drop("reply"), extractor, replies)
    elif extractor is not None:
        rows = extract_missing(rows.drop("reply"), extractor)
    elif "reply" not in rows.columns:
        rows = rows.withColumn("reply", F.lit(None).cast("string"))
    filled = fill_metadata(rows, job.as_of)
    return ws.stage(
        filled.select("doc_id", "path", "subfolder", "confidence", "date", "subject"), "understood"
    )


def file_away(ws: Workspace, understood: DataFrame, existing: Existing, job: JobSettings) -> DataFrame:
    """Manifest rows, tax copies included, given ``folder, name`` of the files already there (see ``filing.manifest``)."""
    bucket = route("confidence", job.threshold)
    root = F.when(bucket == "Review", F.lit(job.review_root)).otherwise(F.lit(job.unsure_root))
    named = understood.select(
        "doc_id",
        "path",
        bucket.alias("bucket"),
        root.alias("root"),
        "subfolder",
        build_name("date", "subject").alias("name"),
    )
    rows = ws.stage(manifest(ws, named, existing, job.mode), "filed")
    return rows.unionByName(tax_copies(rows, job.review_root))


def ingest(
    ws: Workspace,
    docs: DataFrame,
    model: Model,
    existing: Existing,
    job: JobSettings,
    extractor: Callable[[], Extractor] | None = None,
    replies: str | None = None,
) -> DataFrame:
    return file_away(ws, understand(ws, docs, model, job, extractor, replies), existing, job)


def read_inbox(ws: Workspace, files: DataFrame, reader: PageReader) -> DataFrame:
    """Staged ``doc_id, path, text, mtime, error`` of file rows; ``doc_id`` is the path.

    A file that cannot be read has an empty text and the error; the others go on. The contents are read
    once, here.
    """
    pages = read_pages(files, reader, keep="modificationTime timestamp")
    rows = pages.select(
        F.col("path").alias("doc_id"),
        "path",
        F.coalesce(page_text("pages"), F.lit("")).alias("text"),
        F.col("modificationTime").alias("mtime"),
        "error",
    )
    return ws.stage(rows, "inbox")


def ingest_folder(
    ws: Workspace,
    root: str,
    reader: PageReader,
    model: Model,
    existing: Existing,
    job: JobSettings,
    extractor: Callable[[], Extractor] | None = None,
    replies: str | None = None,
) -> DataFrame:
    """The manifest of the PDF files directly in a folder: scan, read, classify, name, route, file."""
    docs = read_inbox(ws, scan_inbox(ws.spark, root), reader).drop("error")
    return ingest(ws, docs, model, existing, job, extractor, replies)
