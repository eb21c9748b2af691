"""Folders of very many files, on a file system that tasks reach by themselves.

Spark's own listing and file streams keep an object per file in the driver, several of them while a batch runs. Here a task
(for a stream, the source's own process) goes through the folder and writes what it finds as rows, and the
tasks that need contents open the files. The driver holds nothing per file. Rows are those of Spark's reader.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BinaryType

from belegwerk.workspace import Workspace

PDF_NAME = re.compile(r"\.[pP][dD][fF]\Z")
LISTING_SCHEMA = "path string, modificationTime timestamp, length long"
ARROW_SCHEMA = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", tz="UTC")), ("length", pa.int64())])
# Files and bytes that one task reads, and rows of a listing that are held at a time.
TASK_FILES = 500
TASK_BYTES = 64 << 20
LISTED_ROWS = 10_000

Entry = tuple[str, int, int]


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The plain path of a folder on the local file system, none on any other; on a cluster it is a mount that all share."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toUri().getPath() if system.getUri().getScheme() == "file" else None


def _is_hidden(name: str) -> bool:
    """Whether Spark's reader leaves out a name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def entries(folder: str, deep: bool) -> Iterator[Entry]:
    """Path, time in microseconds and length of the PDF files directly in a folder, or at any depth.

    Empty files are left out, as by Spark's reader; one that is being written comes once it has something in it.
    """
    folders = [folder]
    while folders:
        with os.scandir(folders.pop()) as found:
            for entry in found:
                if _is_hidden(entry.name):
                    continue
                try:
                    if entry.is_dir():
                        if deep:
                            folders.append(entry.path)
                    elif PDF_NAME.search(entry.name):
                        entry.path.encode()
                        status = entry.stat()
                        if not status.st_size:
                            continue
                        # The JVM has times in milliseconds.
                        yield f"file:{entry.path}", status.st_mtime_ns // 1_000_000 * 1000, status.st_size
                except (FileNotFoundError, UnicodeEncodeError):
                    # Gone meanwhile, a dead link, or a name that the JVM cannot open either.
                    continue


def _batch(rows: list[Entry]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_SCHEMA)], schema=ARROW_SCHEMA)


def _runs(found: Iterator, size: int) -> Iterator[list]:
    while rows := list(islice(found, size)):
        yield rows


def _read(path: str) -> bytes:
    with open(path.removeprefix("file:"), "rb") as file:
        return file.read()


# Rows go to and fro a hundred at a time, so few contents are in memory at once.
read_content = F.udf(_read, BinaryType(), useArrow=False)


def has_more(folder: str, deep: bool, files: int) -> bool:
    """Whether there are more PDF files than that; no more of them are looked at."""
    return next(islice(entries(folder, deep), files, None), None) is not None


def listed(spark: SparkSession, folder: str, deep: bool) -> DataFrame:
    """``path, modificationTime, length, content`` of the PDF files that are there now; contents are read where they are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from map(_batch, _runs(entries(folder, deep), LISTED_ROWS))

    files = Workspace(spark).stage(spark.range(1).mapInArrow(run, LISTING_SCHEMA), "listing")
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-size // TASK_BYTES))
    return files.repartition(tasks).withColumn("content", read_content("path"))


# --- streams ---


def watched(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """A stream of the PDF files directly in a folder, with the columns of ``listed``; ``log`` is the query's own folder."""
    spark.dataSource.register(InboxSource)
    tasks = str(spark.sparkContext.defaultParallelism)
    rows = spark.readStream.format(InboxSource.name()).options(folder=folder, log=log, tasks=tasks).load()
    return rows.withColumn("content", read_content("path"))


class InboxSource(DataSource):
    """Each file of a folder once. What has been taken up is a log of versions, and the offset is a version's number."""

    @classmethod
    def name(cls) -> str:
        return "belegwerk_inbox"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def streamReader(self, schema: object) -> InboxReader:
        return InboxReader(self.options["folder"], self.options["log"], int(self.options["tasks"]))


class InboxReader(DataSourceStreamReader):
    """Versions of a log: folders of slices, JSON lines of the files that one task reads.

    A version is written under another name and then renamed, so it is there whole or not at all, and never
    changes: a replayed batch has the same files. The files of all versions are known by 128-bit marks.
    """

    def __init__(self, folder: str, log: str, tasks: int) -> None:
        self.folder, self.log, self.tasks = folder, log, tasks
        self.version = 0
        self._marks = np.empty(0, "S32")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        learnt: list[np.ndarray] = []
        while os.path.isdir(self._at(self.version + 1)):
            self.version += 1
            learnt += [_marks_of([entry[0] for entry in _lines(path)]) for path in self._slices(self.version)]
        self._marks = np.sort(np.concatenate((self._marks, *learnt)))
        self._take_up()
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        versions = range(start["version"] + 1, end["version"] + 1)
        return [InputPartition(path) for version in versions for path in self._slices(version)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield _batch([tuple(entry) for entry in _lines(partition.value)])

    def _at(self, version: int) -> str:
        return os.path.join(self.log, f"{version:08d}")

    def _slices(self, version: int) -> list[str]:
        return sorted(entry.path for entry in os.scandir(self._at(version)))

    def _take_up(self) -> None:
        """Add the files that no version has as a version, if there are any."""
        hidden = os.path.join(self.log, f".{uuid.uuid4().hex}")
        os.makedirs(hidden)
        every = os.path.join(hidden, "all")
        n, learnt = 0, []
        with open(every, "w") as out:
            for rows in _runs(entries(self.folder, False), LISTED_ROWS):
                marks = _marks_of([row[0] for row in rows])
                at = np.minimum(np.searchsorted(self._marks, marks), max(len(self._marks) - 1, 0))
                new = self._marks[at] != marks if len(self._marks) else np.ones(len(marks), bool)
                out.writelines(json.dumps(row) + "\n" for row, is_new in zip(rows, new) if is_new)
                n += int(new.sum())
                learnt.append(marks[new])
        if n:
            self._deal(every, hidden, min(TASK_FILES, -(-n // self.tasks)))
            os.remove(every)
            os.rename(hidden, self._at(self.version + 1))
            self.version += 1
            self._marks = np.sort(np.concatenate((self._marks, *learnt)))
        else:
            shutil.rmtree(hidden)

    @staticmethod
    def _deal(every: str, folder: str, files: int) -> None:
        """Slices of a list, each with at most that many files, and no more bytes than a task reads."""
        number, held, size, out = 0, files, 0, None
        with open(every) as lines:
            for line in lines:
                length = json.loads(line)[2]
                if held >= files or size + length > TASK_BYTES:
                    if out:
                        out.close()
                    out = open(os.path.join(folder, f"{number:08d}.jsonl"), "w")
                    number, held, size = number + 1, 0, 0
                out.write(line)
                held, size = held + 1, size + length
        if out:
            out.close()


def _lines(path: str) -> Iterator[list]:
    with open(path) as lines:
        yield from map(json.loads, lines)


def _marks_of(paths: list[str]) -> np.ndarray:
    return np.array([hashlib.blake2b(path.encode(), digest_size=16).hexdigest() for path in paths], "S32")


# --- writing ---


# What Spark escapes in the name of a partition's folder, beside control characters.
ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^")


def _partition_folder(name: str, value: str | None) -> str:
    """``name=value`` as Spark writes it."""
    if not value:
        return f"{name}=__HIVE_DEFAULT_PARTITION__"
    return f"{name}={''.join(f'%{ord(c):02X}' if c < ' ' or c in ESCAPED else c for c in value)}"


def write_lines(rows: DataFrame, folder: str, extension: str, by: tuple[str, ...] = ()) -> None:
    """One file per row of ``line, *by`` in folders ``by=value``; a null line is an empty file.

    A task's files are named by its number, so another attempt at it replaces them.
    """
    run_id = uuid.uuid4()

    def run(part: Iterator[Row]) -> None:
        context = TaskContext.get()
        made = set()
        for number, (line, *values) in enumerate(part):
            at = os.path.join(folder, *map(_partition_folder, by, values))
            if at not in made:
                os.makedirs(at, exist_ok=True)
                made.add(at)
            name = f"part-{context.partitionId():05d}-{run_id}-c{number:03d}.{extension}"
            hidden = os.path.join(at, f".{name}.{context.taskAttemptId()}")
            with open(hidden, "wb") as out:
                out.write(b"" if line is None else line.encode() + b"\n")
            os.replace(hidden, os.path.join(at, name))

    os.makedirs(folder, exist_ok=True)
    # Rows reach Python a hundred at a time.
    rows.select("line", *by).foreachPartition(run)
