"""Inputs of the catalogue queries, derived by Spark from the given tables."""

from __future__ import annotations

import base64
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.functions.text import long_enough, normalize_text
from belegwerk.sources.local_files import local_folder, write_lines
from belegwerk.workspace import Workspace, spread

AS_OF = datetime.date(2026, 1, 1)
# Tasks put their files in place themselves; else the driver would move them one by one.
FILE_PER_ROW = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
MONTH_TITLES = (
    "Januar", "Februar", "März", "April", "Mai", "Juni",
    "Juli", "August", "September", "Oktober", "November", "Dezember",
)


class Tables:
    """The driver tables of one folder and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.ws = Workspace(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.read("documents")

    def spread(self, name: str, key: str) -> DataFrame:
        return spread(self.read(name), key)

    @property
    def norms(self) -> DataFrame:
        return self.spread("documents", "doc_id").select("doc_id", normalize_text("text").alias("norm"))

    @property
    def doc_paths(self) -> DataFrame:
        """Documents in folders ``/root/lang/source``, every 50th directly below the root."""
        flat = F.expr("concat('/root/', doc_id, '.pdf')")
        deep = F.expr("concat('/root/', lang, '/', source, '/', doc_id, '.pdf')")
        path = F.when(F.col("doc_id") % 50 == 0, flat).otherwise(deep)
        return self.documents.withColumn("path", path)

    @property
    def corpus(self) -> DataFrame:
        """Staged ``doc_id, label, norm`` of all documents with enough text to learn from."""
        labelled = self.spread("documents", "doc_id").select(
            "doc_id", F.concat_ws("/", "lang", "source").alias("label"), normalize_text("text").alias("norm")
        )
        # A filter before the write would normalise every text twice.
        return self.ws.stage(labelled, "corpus").where(long_enough("norm"))

    @property
    def fine_labels(self) -> DataFrame:
        """``doc_id, label`` with many small labels, single ones among them."""
        return self.documents.select(
            "doc_id", F.expr("concat(lang, '/', source, '/', n_chars % 12)").alias("label")
        )

    @property
    def doc_dates(self) -> DataFrame:
        """Orders as texts with a date, year-first every 2nd, an impossible day every 7th."""
        return self.read("orders").withColumn(
            "text",
            F.expr(
                """concat('Rechnung ', o_orderkey, ' vom ',
                     case when o_orderkey % 7 = 0 then date_format(o_orderdate, "'31.02.'yyyy")
                          when o_orderkey % 2 = 0 then date_format(o_orderdate, 'yyyy - MM / dd')
                          else date_format(o_orderdate, 'dd.MM.yyyy') end)"""
            ),
        )

    @property
    def doc_months(self) -> DataFrame:
        """Orders as texts with a month and year: every 3rd without a blank, every 5th misspelt."""
        titles = F.array(*[F.lit(m) for m in MONTH_TITLES])
        title = F.element_at(titles, F.month("o_orderdate"))
        key = F.col("o_orderkey")
        title = F.when(key % 5 == 0, F.concat(title, F.right(title, F.lit(1)))).otherwise(title)
        title = F.when(key % 4 == 0, F.upper(title)).otherwise(title)
        blank = F.when(key % 3 == 0, F.lit("")).otherwise(F.lit(" "))
        year = (F.year("o_orderdate") + 4).cast("string")
        text = F.concat(F.lit("Abrechnung "), title, blank, year, F.lit(" Blatt "), key.cast("string"))
        return self.spread("orders", "o_orderkey").withColumn("text", text)

    @property
    def replies(self) -> DataFrame:
        """Orders with an extractor's reply, some of them broken in different ways."""
        rows = self.read("orders").withColumn(
            "reply",
            F.expr(
                """case when o_orderkey % 7 = 0 then concat('keine Antwort ', o_orderkey)
                     when o_orderkey % 11 = 0 then concat('[', o_orderkey, ', 2]')
                     when o_orderkey % 5 = 0 then concat('{"date":"', date_format(o_orderdate, 'yyyy.M.d'), '"}')
                     else concat('{"date":"',
                       case when o_orderkey % 17 = 0 then '2001.2.30'
                            when o_orderkey % 3 = 0 then date_format(o_orderdate, 'yyyy.MM.dd')
                            else date_format(o_orderdate, 'yyyy.M.d') end,
                       '","subject":"',
                       case when o_orderkey % 13 = 0 then '' else concat('Auftrag ', o_orderpriority) end,
                       '"}') end"""
            ),
        )
        marred = F.expr(
            """case when o_orderkey % 19 = 0 then concat(reply, ' danke')
                 when o_orderkey % 23 = 0 then concat(reply, '{"a":1}')
                 when o_orderkey % 29 = 0 then replace(reply, '"', "'") else reply end"""
        )
        return rows.withColumn("reply", marred)

    @property
    def rule_docs(self) -> DataFrame:
        """Orders as payroll and fund documents for the subject rules."""
        return self.doc_months.select(
            "o_orderkey",
            F.expr(
                """case o_orderkey % 4 when 3 then 'de/src1'
                     when 2 then 'Versicherungen/Investmentfonds Riester - Deka'
                     else 'Lohnabrechnungen/2016.06.01 Canway' end"""
            ).alias("subfolder"),
            F.expr(
                """concat(case when o_orderkey % 6 = 0 then 'Meldebescheinigung zur Sozialversicherung '
                     when o_orderkey % 6 = 2 then 'Quartalsbericht ERTRAGSAUSSCHÜTTUNG '
                     when o_orderkey % 6 = 3 then 'Quartalsbericht '
                     when o_orderkey % 6 = 4 then 'Abrechnungder Brutto/Netto-Bezüge '
                     else 'Brutto Abrechnung ' end, text)"""
            ).alias("text"),
        )

    @property
    def inbox_docs(self) -> DataFrame:
        """Documents as inbox files with a modification time and some replies."""
        return self.spread("documents", "doc_id").select(
            "doc_id",
            F.expr(
                """concat('/inbox/Beleg ', doc_id, case when doc_id % 10 = 0 then ' Steuer' else '' end,
                     case when doc_id % 15 = 0 then ' TAX' else '' end,
                     case when doc_id % 13 = 0 then '.txt' when doc_id % 9 = 0 then '.PDF' else '.pdf' end)"""
            ).alias("path"),
            "text",
            F.expr("timestamp '2024-01-01 12:00:00' + make_interval(0, 0, 0, cast(doc_id % 300 as int))").alias("mtime"),
            F.expr(
                """case when doc_id % 4 = 0 then concat('{"date":"2023.', doc_id % 12 + 1, '.5","subject":"Vorgang ', source, '"}')
                     when doc_id % 4 = 1 then concat('{"date":"","subject":""}') end"""
            ).alias("reply"),
        )

    @property
    def page_files(self) -> DataFrame:
        """``page_id, line``: a page as one line of a file."""
        body = F.concat(F.col("page_id").cast("string"), F.lit("|"), F.col("html"))
        line = F.regexp_replace(F.base64(body.cast("binary")), "[\r\n]", "")
        return self.read("pages").select("page_id", line.alias("line"))

    def write_files(self, rows: DataFrame, root: str, extension: str) -> None:
        """Add one file per row to a folder."""
        self._write_files(rows.select("line"), root, extension)

    def _write_files(self, rows: DataFrame, root: str, extension: str, *by: str) -> None:
        """One file per row of ``line``, in folders of the values of ``by``."""
        # Every task may write into every folder: a task per folder would hold a share of the files that grows with them.
        rows = rows.repartition(self.spark.sparkContext.defaultParallelism)
        folder = local_folder(self.spark, root)
        if folder is not None:
            # Hadoop's local file system starts a process per file, for its permissions.
            write_lines(rows, folder, extension, by)
            return
        writer = rows.write.mode("append").options(**FILE_PER_ROW).option("extension", extension)
        (writer.partitionBy(*by) if by else writer).csv(root)

    def document_folder(self) -> str:
        """A folder of documents as files, each in the folder of its language and source."""
        root = self.ws.path("archive")
        body = F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("text"))
        line = F.regexp_replace(F.base64(body.cast("binary")), "[\r\n]", "")
        self._write_files(self.documents.select("lang", "source", line.alias("line")), root, "pdf", "lang", "source")
        return root

    def page_folder(self) -> str:
        """A folder of page files: three quarters at the top, a quarter below, and some notes."""
        root = self.ws.path("inbox")
        files = self.page_files
        self.write_files(files.where("page_id % 4 < 2"), root, "pdf")
        self.write_files(files.where("page_id % 4 = 2"), root, "PDF")
        self.write_files(files.where("page_id % 4 = 3"), f"{root}/alt", "pdf")
        self.write_files(files.where("page_id % 10 = 0"), root, "txt")
        return root


def _body(content: bytes) -> tuple[str, str]:
    body = base64.b64decode(content.strip(), validate=True).decode("utf-8")
    number, _, text = body.partition("|")
    return number, text


def decode_text(content: bytes) -> list[str]:
    """Page reader for the same files that leaves out the number."""
    return [_body(content)[1]]


def page_of_file(files: DataFrame) -> DataFrame:
    """``path, page_id, html`` of file rows written by ``write_files``."""
    body = F.unbase64(F.rtrim(F.col("content").cast("string"), F.lit("\n"))).cast("string")
    return files.select("path", body.alias("body")).select(
        "path",
        F.substring_index("body", "|", 1).cast("long").alias("page_id"),
        F.substring(F.col("body"), F.locate("|", "body") + 1, F.length("body")).alias("html"),
    )


def decode_page(content: bytes) -> list[str]:
    """Page reader for files written by ``write_files``."""
    number, text = _body(content)
    return [number, "", text]
