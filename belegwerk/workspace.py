"""Tables written between the steps of a job, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where that is unset."""
    global _fallback_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="belegwerk-")
    return _fallback_dir


class Workspace:
    """One run's folder below the shared directory.

    A staged table cuts lineage: a lost executor costs the tasks that read it, not the steps that
    made it. Catalyst also knows its size, so it can pick joins from measured bytes.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.root = root or f"{shared_dir(spark)}/belegwerk/{app}/{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def close(self) -> None:
        """Delete the run's staged tables, once nothing reads them any more; also at the end of a ``with``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def stage(self, df: DataFrame, name: str, codec: str | None = None, slices: int = 0) -> DataFrame:
        """``df`` written and read back; ``codec`` is a Parquet compression, the session's where none is given.

        Its shuffles have at least ``slices`` partitions.
        """
        path = self.path(name)
        with shuffled_in(self.spark, slices):
            (df.write.option("compression", codec) if codec else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled_in(spark: SparkSession, slices: int) -> Iterator[None]:
    """Shuffles of what is run inside have at least ``slices`` partitions; adaptive execution merges small ones.

    A fixed number of partitions makes each of them, and the memory of its task, grow with the input.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if slices <= int(before):
        yield
        return
    spark.conf.set(key, str(slices))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffle files at its end; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, made without Python workers; ``schema`` is ``name type, ...``."""
    fields = [field.strip().split(" ", 1) for field in schema.split(",")]
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores when its source has too few splits for them; a large source stays as it is.

    Text work costs far more than the shuffle of the text itself, and a small file is one split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def measure(df: DataFrame) -> tuple[int, int]:
    """Row count and an upper estimate of the bytes a table takes as JSON."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("b"),
    ).first()
    return row.n, row.b
