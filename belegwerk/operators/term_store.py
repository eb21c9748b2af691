"""Term counts of a corpus, kept from one training to the next.

A store is a folder of versions and a log. A version adds the term counts of documents that came in and
has a list of all documents and a table of term frequencies, to which what came is added and from which what
went is taken away. So a training reads only new texts, and gives what a full one would.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.functions.text import long_enough
from belegwerk.operators.bayes import Model, NotEnoughData, fit_counts, fit_vectors, label_table
from belegwerk.operators.features import known_vectors, row_slices, term_freq, text_slices, within_limits
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace, empty, shuffled_in

DOCS = "doc_id long, label string, content_hash string, kept boolean, part string"
TERMS = "doc_id long, terms array<struct<term string, tf bigint>>"
FREQS = "term string, df long, cf long"
# The lists of all terms are the largest tables of a training.
CODEC = "zstd"
# More parts than this are written anew as one.
MOST_PARTS = 16


@dataclass(frozen=True)
class Version:
    """What a log record names: the folder with ``docs`` and ``freqs``, and the folders with terms."""

    folder: str
    parts: tuple[str, ...]


class TermStore:
    """The store in a folder, at the version that its log named last when it was opened."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._log = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self._files = self._log.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in self._files.listStatus(self._log)] if self._files.exists(self._log) else []
        self.number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
        self.version = self._record() if self.number else None

    def _at(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._log, f"{number:06d}.json")

    def _record(self) -> Version:
        stream = self._files.open(self._at(self.number))
        try:
            record = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(record["folder"], tuple(record["parts"]))

    def _commit(self, version: Version) -> None:
        """Write the next record; where another job wrote it first this one fails and changes nothing."""
        stream = self._files.create(self._at(self.number + 1), False)
        stream.write(bytearray(json.dumps({"folder": version.folder, "parts": list(version.parts)}).encode()))
        stream.close()

    def _read(self, schema: str, folder: str | None, table: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{table}") if folder else empty(self.spark, schema)

    @property
    def docs(self) -> DataFrame:
        """``doc_id, label, content_hash, kept, part``; too short texts are not ``kept`` and have no terms."""
        return self._read(DOCS, self.version and self.version.folder, "docs")

    @property
    def freqs(self) -> DataFrame:
        """``term, df, cf`` over the kept documents."""
        return self._read(FREQS, self.version and self.version.folder, "freqs")

    def terms_of(self, docs: DataFrame) -> DataFrame:
        """``docs`` (``doc_id, part`` and more) with their ``terms``; documents and parts meet by key, one row each."""
        return docs.join(self._all_terms(), ["doc_id", "part"])

    def _all_terms(self) -> DataFrame:
        """``doc_id, terms, part`` of all parts, with documents that have gone or have a newer content in another part."""
        rows = empty(self.spark, DOCS).select("doc_id", F.lit(None).cast("array<struct<term: string, tf: bigint>>").alias("terms"), "part")
        for part in self.version.parts if self.version else ():
            rows = rows.unionByName(self._read(TERMS, part, "terms").withColumn("part", F.lit(part)))
        return rows

    def advance(self, ws: Workspace, files: DataFrame, read: Callable[[DataFrame], DataFrame]) -> TermStore:
        """The store for ``files`` (``doc_id, label, content_hash``), whose ``doc_id`` is unique.

        ``read`` turns ``doc_id, content_hash`` of documents that are new or have a new content into
        ``doc_id, norm``; what it leaves out is not in the store and is asked for again next time. A document that
        only changed its label is not read.
        """
        folder = uuid.uuid4().hex
        at = f"{self.path}/{folder}"
        old = self.docs
        match = ["doc_id", "content_hash"]
        matched = ws.stage(files.select("doc_id", "label", "content_hash").join(old.drop("label"), match, "left"), "matched")
        fresh = matched.where("part is null")
        whole = self.version is not None and len(self.version.parts) >= MOST_PARTS
        stay = matched.where("part is not null")
        # The texts go as soon as they are counted.
        with Workspace(ws.spark, ws.path("texts")) as texts:
            norms = texts.stage(read(fresh.select(*match)).select("doc_id", "norm", F.coalesce(long_enough("norm"), F.lit(False)).alias("kept")), "norms", CODEC)
            counts = term_freq(norms.where("kept")).where("term is not null")
            added = counts.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
            if whole:
                added = added.unionByName(self.terms_of(stay.select("doc_id", "part")).select("doc_id", "terms"))
            # What tasks group grows with the texts that came and with the terms that are there.
            slices = text_slices(norms) + row_slices(self.freqs.agg(F.sum("df")).first()[0] or 0)
            with shuffled_in(self.spark, slices):
                added.write.option("compression", CODEC).parquet(f"{at}/terms")
            entered = ws.stage(norms.select("doc_id", "kept"), "entered")

        came = self._read(TERMS, folder, "terms")
        if whole:
            came = came.join(entered.select("doc_id"), "doc_id", "left_semi")
        gone = ws.stage(old.where("kept").join(files, match, "left_anti").select("doc_id", "part"), "gone")
        freqs = self.freqs.unionByName(_frequencies(came, 1))
        if self.version is not None and not gone.isEmpty():
            freqs = freqs.unionByName(_frequencies(self.terms_of(gone), -1))
        freqs = freqs.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        with shuffled_in(self.spark, slices):
            freqs.where("df > 0").write.option("compression", CODEC).parquet(f"{at}/freqs")

        if whole:
            stay = stay.withColumn("part", F.lit(folder))
        entered = fresh.drop("kept", "part").join(entered, "doc_id").withColumn("part", F.lit(folder))
        stay.unionByName(entered).select("doc_id", "label", "content_hash", "kept", "part").write.parquet(f"{at}/docs")
        parts = (folder,) if whole or self.version is None else (*self.version.parts, folder)
        self._commit(Version(folder, parts))
        return TermStore(self.spark, self.path)

    def fit(
        self,
        ws: Workspace,
        min_df: int = settings.MIN_DF,
        max_df: float = settings.MAX_DF,
        max_terms: int = settings.MAX_TERMS,
        alpha: float = settings.ALPHA,
    ) -> Model:
        """The model that ``bayes.fit`` gives for the store's documents, without their texts."""
        docs = self.docs.where("kept")
        labels = label_table(ws, docs)
        n_docs = labels.agg(F.sum("n_docs")).first()[0] or 0
        if not n_docs:
            raise NotEnoughData("no training data")
        tagged = lookup_join(docs.select("doc_id", "label", "part"), labels.select("label", "label_id"), "label")
        tagged = tagged.select("doc_id", "label_id", "part")
        freqs = within_limits(self.freqs, n_docs, min_df, max_df)
        if docs.agg(F.countDistinct("doc_id")).first()[0] < n_docs:
            # Rows of a repeated key make up one vector, so they meet before it gets its length.
            tf = self.terms_of(tagged).select("doc_id", "label_id", F.inline("terms"))
            return fit_counts(ws, labels, tf, freqs, n_docs, max_terms, alpha)
        tf = self._all_terms().select("doc_id", "part", F.inline("terms"))

        def rows_of(vocab: DataFrame) -> DataFrame:
            # Labels meet vectors of known terms, which are far smaller than the lists of all terms.
            return known_vectors(tf, vocab, ("part",)).join(tagged, ["doc_id", "part"])

        return fit_vectors(ws, labels, rows_of, freqs, n_docs, max_terms, alpha)


def _frequencies(terms: DataFrame, sign: int) -> DataFrame:
    """``term, df, cf`` of documents' terms, times ``sign``."""
    rows = terms.select(F.inline("terms")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return rows.select("term", (F.col("df") * sign).alias("df"), (F.col("cf") * sign).alias("cf"))
