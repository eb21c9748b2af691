"""Folder stream: each settled batch of files goes through a job once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from belegwerk import settings
from belegwerk.functions.paths import parent
from belegwerk.operators.bayes import Model
from belegwerk.operators.metadata import Extractor
from belegwerk.operators.name_index import NameIndex
from belegwerk.plans.ingest import ingest
from belegwerk.settings import JobSettings
from belegwerk.sources.files import taken_up
from belegwerk.workspace import Workspace, empty

Process = Callable[[DataFrame, int], DataFrame]

METRICS_SCHEMA = "batch_id long, n_files long, n_rows long"


def start(stream: DataFrame, process: Process, out: str, available_now: bool = True) -> StreamingQuery:
    """Run ``process`` on every micro-batch; rows go to ``out/rows``, counts to ``out/metrics``.

    Each batch overwrites its own ``batch_id`` folder, so a replayed batch leaves no double rows. An
    error in ``process`` ends the query, and a restart takes up the same batch again. Stop and
    restart at any time: progress is in ``out/checkpoint``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows_path = f"{out}/rows/batch_id={batch_id}"
        process(batch, batch_id).write.mode("overwrite").parquet(rows_path)
        rows = batch.sparkSession.read.parquet(rows_path)
        n_rows = rows.agg(F.count(F.lit(1)).alias("n_rows"))
        n_files = batch.select("path").agg(F.count(F.lit(1)).alias("n_files"))
        metrics = n_files.select("n_files", n_rows.scalar().alias("n_rows"))
        metrics.write.mode("overwrite").parquet(f"{out}/metrics/batch_id={batch_id}")

    writer = taken_up(stream, out).writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_settled(
    stream: DataFrame,
    clock: DataFrame,
    files: Callable[[], DataFrame],
    process: Process,
    out: str,
    gap_seconds: float = settings.SETTLE_SECONDS,
    available_now: bool = True,
) -> StreamingQuery:
    """``start`` for inboxes that are passed on only once they have been quiet for longer than the gap.

    ``stream`` has file rows with ``path, modificationTime``, the folder of a file is its inbox. ``clock`` is
    a stream with a column ``ts`` of times that have passed, without which a quiet stream has no batches.
    Files that are not settled stay in a small table, one version per batch under ``out/pending``;
    ``files`` lists what is there now with contents, so a file that has been written to since is held
    back and one that has gone is forgotten. ``process`` gets all files of the settled inboxes. A
    replayed batch reads the version before it and overwrites its own.
    """
    gap = F.make_dt_interval(secs=F.lit(gap_seconds))
    arrivals = taken_up(stream, out).select("path", F.col("modificationTime").alias("ts"))
    both = arrivals.unionByName(clock.select(F.lit(None).cast("string").alias("path"), "ts"))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("path", "ts").unionByName(pending_files(spark, out, batch_id))
        # The clock's newest time goes along with the pending files, so it never goes back.
        rows = Workspace(spark).stage(rows, f"arrivals-{batch_id}")
        now = rows.where("path is null").agg(F.max("ts").alias("now"))
        there = files().select("path", "modificationTime")
        waiting = rows.where("path is not null").select("path").distinct().join(there, "path")
        waiting = waiting.withColumn("inbox", parent("path"))
        last = waiting.groupBy("inbox").agg(F.max("modificationTime").alias("last"))
        marked = waiting.join(last.select("inbox", (F.col("last") + gap < now.scalar()).alias("quiet")), "inbox")
        marked = Workspace(spark).stage(marked, f"marked-{batch_id}")
        # A file that is written to after the check has another time when it is read, and waits on.
        settled = files().join(marked.where("quiet").select("path", "modificationTime"), ["path", "modificationTime"], "left_semi")
        settled = Workspace(spark).stage(settled, f"settled-{batch_id}")
        process(settled, batch_id).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        held = marked.join(settled.select("path"), "path", "left_anti").select("path", F.col("modificationTime").alias("ts"))
        held = held.unionByName(now.select(F.lit(None).cast("string").alias("path"), F.col("now").alias("ts")))
        held.write.mode("overwrite").parquet(f"{out}/pending/batch_id={batch_id}")

    writer = both.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# So many failures without one success are no fault of the files.
WHOLE_BATCH = 8
LEDGER_SCHEMA = "path string, attempts int, error string, next_try timestamp"


def start_forgiving(
    stream: DataFrame,
    clock: DataFrame,
    files: Callable[[], DataFrame],
    process: Process,
    out: str,
    attempts: int = settings.FILE_ATTEMPTS,
    pause_seconds: float = settings.ERROR_PAUSE_SECONDS,
    available_now: bool = True,
) -> StreamingQuery:
    """``start`` for batches in which some file makes ``process`` fail: it is set aside, and the batch goes on.

    ``stream``, ``clock`` and ``files`` are as in ``start_settled``. A batch that fails is halved by file until what
    fails is one file (``apart``); all others are filed with their batch. A file that failed stands in a
    ledger, one version per batch under ``out/ledger``, with its error and the time of its next try, which is
    ``pause_seconds`` away and twice as far after each failure. After ``attempts`` tries it is given up and
    becomes a row of ``given_up``. If nothing in a batch of several files succeeds, the fault is not
    the files': the query ends, and a restart takes up the same batch. A file that has gone is forgotten. A
    replayed batch reads the version before it and overwrites its own.
    """
    arrivals = taken_up(stream, out).select("path", F.lit(None).cast("timestamp").alias("ts"))
    both = arrivals.unionByName(clock.select(F.lit(None).cast("string").alias("path"), "ts"))

    def run(batch: DataFrame, batch_id: int) -> None:
        ws = Workspace(batch.sparkSession)
        new = batch.where("path is not null").select("path", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("next_try"))
        ticks = batch.where("path is null").select(F.lit(None).cast("string").alias("path"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("next_try"))
        rows = ws.stage(new.unionByName(ticks).unionByName(ledger(ws.spark, out, batch_id - 1)), f"arrivals-{batch_id}")
        now = rows.where("path is null").agg(F.max("next_try").alias("now")).first().now
        due = F.col("next_try").isNull() | (F.col("next_try") <= F.lit(now).cast("timestamp"))
        tried = ws.stage(rows.where(F.col("path").isNotNull() & due).groupBy("path").agg(F.max("attempts").alias("attempts")), f"due-{batch_id}")
        given = ws.stage(files().join(tried.select("path"), "path", "left_semi"), f"files-{batch_id}")
        done, failed = apart(ws, given, process, batch_id)
        path = f"{out}/rows/batch_id={batch_id}"
        # Without any success the batch's rows are an empty table, also where a run before has left some.
        for i, part in enumerate(done or [process(given.limit(0), batch_id)]):
            part.write.mode("append" if i else "overwrite").parquet(path)
        errors = ws.spark.createDataFrame(failed, "path string, error string") if failed else empty(ws.spark, "path string, error string")
        counted = tried.join(errors, "path").withColumn("attempts", F.col("attempts") + 1)
        pause = F.make_dt_interval(secs=F.lit(pause_seconds) * F.pow(F.lit(2), F.col("attempts") - 1))
        again = counted.where(F.col("attempts") < attempts).withColumn("next_try", F.coalesce(F.lit(now).cast("timestamp"), F.current_timestamp()) + pause)
        waiting = rows.where(F.col("path").isNotNull() & ~due)
        tick = empty(ws.spark, LEDGER_SCHEMA) if now is None else rows.where("path is null").agg(F.max("next_try").alias("next_try")).select(
            F.lit(None).cast("string").alias("path"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), "next_try"
        )
        kept = waiting.unionByName(again.select(*waiting.columns)).unionByName(tick)
        kept.write.mode("overwrite").parquet(f"{out}/ledger/batch_id={batch_id}")
        lost = counted.where(F.col("attempts") >= attempts).select("path", "attempts", "error")
        lost.write.mode("overwrite").parquet(f"{out}/given_up/batch_id={batch_id}")

    writer = both.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def apart(ws: Workspace, files: DataFrame, process: Process, batch_id: int) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """The staged rows of what can be processed of staged ``files``, and the path and error of each file that cannot.

    A part that fails is halved by a hash of the path, so one bad file among n costs about twice log2(n)
    attempts, the larger of them on files that are good. A part of a part is written before it is halved again:
    a condition on the whole table would read all its contents for every attempt.
    """
    done: list[DataFrame] = []
    failed: list[tuple[str, str]] = []
    parts = [(files, 0)]
    while parts:
        part, depth = parts.pop()
        if depth and part.select("path").isEmpty():
            continue
        try:
            done.append(ws.stage(process(part, batch_id), f"done-{batch_id}"))
            continue
        except Exception as error:  # whatever a job raises is data here
            some = [r.path for r in part.select("path").distinct().limit(2).collect()]
            if not some:
                raise
            reason = (str(error).strip().splitlines() or [type(error).__name__])[0][:1000]
        if len(some) == 1:
            failed.append((some[0], reason))
            if len(failed) >= WHOLE_BATCH and not done:
                raise RuntimeError(f"nothing in batch {batch_id} could be processed: {reason}")
            continue
        if depth:
            part = ws.stage(part, f"part-{batch_id}")
        side = F.pmod(F.xxhash64(F.lit(depth), "path"), F.lit(2))
        parts += [(part.where(side == i), depth + 1) for i in (0, 1)]
    return done, failed


def ledger(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """``path, attempts, error, next_try`` of the files that wait after a batch; a null path has the clock's time."""
    if batch_id < 0:
        return empty(spark, LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{out}/ledger/batch_id={batch_id}")


def given_up(spark: SparkSession, out: str) -> DataFrame:
    """``path, attempts, error, batch_id`` of the files that no batch takes up again."""
    return spark.read.option("basePath", f"{out}/given_up").parquet(f"{out}/given_up/batch_id=*")


def pending_files(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """``path, ts`` that the last batch before this one has left; only that version is read."""
    if batch_id == 0:
        return empty(spark, "path string, ts timestamp")
    return spark.read.parquet(f"{out}/pending/batch_id={batch_id - 1}").select("path", "ts")


def sink_rows(spark: SparkSession, out: str) -> DataFrame:
    """All rows written so far, with their ``batch_id``."""
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch_id=*")


def metrics(spark: SparkSession, out: str) -> DataFrame:
    """``batch_id, n_files, n_rows``: one row per batch."""
    rows = spark.read.option("basePath", f"{out}/metrics").parquet(f"{out}/metrics/batch_id=*")
    return rows.select(F.col("batch_id").cast("long"), "n_files", "n_rows")


def totals(metrics_rows: DataFrame) -> DataFrame:
    return metrics_rows.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
    )


def ingest_batches(
    ws: Workspace,
    read: Callable[[DataFrame], DataFrame],
    model: Model,
    job: JobSettings,
    out: str,
    extractor: Callable[[], Extractor] | None = None,
) -> Process:
    """A ``process`` that runs the whole job; names given in earlier batches count as taken.

    Those names are looked up in an index under ``out/names``, so a batch does not read all earlier rows. ``read`` turns file rows into ``doc_id, path, text, mtime``. The extractor's replies are stored under
    ``out/replies`` before their batch is filed, so a replayed batch asks for none of them again.
    """

    index = NameIndex(ws, f"{out}/names", f"{out}/rows")

    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        docs = ws.stage(read(batch), f"batch-{batch_id}")
        return ingest(ws, docs, model, lambda wanted: index.meeting(wanted, batch_id), job, extractor, f"{out}/replies")

    return process
