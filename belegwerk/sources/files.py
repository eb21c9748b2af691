"""Document folders as tables. Contents are read only if a query selects them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.functions.text import _col
from belegwerk.sources import local_files
from belegwerk.workspace import empty

PDF_GLOB = "*.[pP][dD][fF]"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

# Beyond that many files a folder is listed by a task; Spark's listing keeps about a kilobyte of each in the driver.
DRIVER_FILES = 10_000

PageReader = Callable[[bytes], Sequence[str]]


def _many_files(spark: SparkSession, root: str, deep: bool) -> DataFrame | None:
    """The table of a folder that holds too many files for the driver, if its file system is the local one."""
    folder = local_files.local_folder(spark, root)
    if folder is None or not os.path.isdir(folder) or not local_files.has_more(folder, deep, DRIVER_FILES):
        return None
    return local_files.listed(spark, folder, deep)


def _is_top_level(spark: SparkSession, root: str) -> Column:
    """Whether a file lies directly in a folder, told by the depth of its path; Spark reads no others.

    The folder is listed as one directory. A pattern for its files would make each of them a path of its own to
    Spark, which lists up to 10,000 of them with a task each.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    depth = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).depth()
    return F.size(F.split(F.regexp_replace("_metadata.file_path", "^[^/]*//[^/]*", ""), "/")) == depth + 2


def _pdf_files(reader):
    """A reader of PDF files at any depth, whose folders are not taken for partitions."""
    return reader.format("binaryFile").option("pathGlobFilter", PDF_GLOB).option("recursiveFileLookup", "true")


def scan_inbox(spark: SparkSession, root: str) -> DataFrame:
    """PDF files directly in a folder, the suffix in any case; a folder without any gives no rows."""
    many = _many_files(spark, root, deep=False)
    if many is not None:
        return many
    try:
        return _pdf_files(spark.read).load(root).where(_is_top_level(spark, root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, FILE_SCHEMA)


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """PDF files at any depth below a folder."""
    many = _many_files(spark, root, deep=True)
    return _pdf_files(spark.read).load(root) if many is None else many


def scan_review(spark: SparkSession, root: str) -> DataFrame:
    """All files at any depth, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length")


def watch_inbox(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming form of ``scan_inbox``: each file once, those already there first.

    ``taken_up`` puts a source in its place that keeps what it has seen in a query's own folder, not in the driver.
    """
    reader = _pdf_files(spark.readStream).schema(FILE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(root).where(_is_top_level(spark, root))
    if not files_per_batch:
        stream.inbox = local_files.local_folder(spark, root)
    return stream


def taken_up(stream: DataFrame, out: str) -> DataFrame:
    """A stream of ``watch_inbox`` as ``local_files.watched`` with its log in ``out/arrived``; any other as it is.

    So is one on another file system, with a bound on the files per batch, or whose checkpoint in ``out`` is older than such logs.
    """
    folder = stream.__dict__.get("inbox")
    at = folder and local_files.local_folder(stream.sparkSession, out)
    if not at:
        return stream
    log = os.path.join(at, "arrived")
    if not os.path.isdir(log) and os.path.isdir(os.path.join(at, "checkpoint", "offsets")):
        return stream
    os.makedirs(log, exist_ok=True)
    return local_files.watched(stream.sparkSession, folder, log)


def read_pages(files: DataFrame, reader: PageReader, keep: str = "") -> DataFrame:
    """``path, pages, error`` of ``path, content`` with a user-supplied reader.

    A file that cannot be read has null pages and the error's text; the other files go on. ``keep`` names
    further columns to carry along, as ``name type, ...``.
    """
    kept = [field.split()[0] for field in keep.split(",") if field.strip()]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            pages: list = []
            errors: list = []
            for content in batch["content"]:
                try:
                    pages.append(list(reader(bytes(content))))
                    errors.append(None)
                except Exception as error:  # whatever a reader raises is data here
                    pages.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            found = pd.DataFrame({"path": batch["path"], "pages": pages, "error": pd.Series(errors, dtype=object)})
            yield found.assign(**{name: batch[name] for name in kept})

    schema = "path string, pages array<string>, error string" + (f", {keep}" if kept else "")
    return files.select("path", "content", *kept).mapInPandas(read, schema)


def page_text(pages: Column | str) -> Column:
    """Pages that are not empty, joined by a line break; null if none is left."""
    full = F.filter(_col(pages), lambda p: F.length(p) > 0)
    return F.when(F.size(full) > 0, F.array_join(full, "\n"))


def assemble_pages(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` from ``doc_id, page_no, text``; a document's text is one value of one row."""
    page = F.when(F.length("text") > 0, F.struct("page_no", "text"))
    ordered = F.transform(F.sort_array(F.collect_list(page)), lambda p: p.text)
    return rows.groupBy("doc_id").agg(ordered.alias("pages")).select(
        "doc_id", page_text("pages").alias("text")
    )
