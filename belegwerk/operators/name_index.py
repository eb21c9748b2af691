"""Names already given, kept so that a batch reads only the names that its own can meet.

One part per batch lies in a folder of its own. Part i holds the names of the batches from ``i - lowbit(i)`` up to
``i - 1``, where ``lowbit`` is i's lowest bit that is set: every second part holds one batch, every fourth two and so on. So
the names before batch n are in as many parts as n has bits set, and each name is written again a logarithmic
number of times. A part follows from its batches' rows alone, so a replay or a second writer makes the same one.

The numbers given to a name are lists over blocks of numbers: a name that was given a million times is a few hundred
rows, and the rows are in buckets of their family, which is all that a wanted name can meet.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.functions.paths import file_name, parent, stem, suffix
from belegwerk.operators.naming import ENDINGS, NUMBERED
from belegwerk.workspace import Workspace, empty

# Numbers of a block, entries of a bucket and most buckets of a part.
BLOCK = 4096
BUCKET_ROWS = 50_000
MOST_BUCKETS = 4096

FAMILY = ["folder", "family", "ext"]
SCHEMA = "folder string, family string, ext string, base string, block long, numbers array<int>"


def parts_before(n: int) -> list[int]:
    """The parts that together hold the batches 0 to n - 1."""
    out = []
    while n > 0:
        out.append(n)
        n -= n & -n
    return out


def merged_parts(i: int) -> list[int]:
    """The parts that part i takes over, next to the names of batch i - 1."""
    return [p for p in parts_before(i - 1) if p > i - (i & -i)]


def _families(names: DataFrame) -> DataFrame:
    """``folder, family, ext, stem`` of ``folder, name``; a family is the name without numbers at its end."""
    return names.select("folder", F.regexp_replace(stem("name"), ENDINGS, "").alias("family"), suffix("name").alias("ext"), stem("name").alias("stem"))


def _blocks(names: DataFrame) -> DataFrame:
    """Index rows of ``folder, name``; a name without a number at its end is number 0 of itself."""
    inner, number = F.regexp_extract("stem", NUMBERED, 1), F.regexp_extract("stem", NUMBERED, 2).try_cast("long")
    is_numbered = number.isNotNull() & (inner != "")
    rows = _families(names).select(
        *FAMILY, F.when(is_numbered, inner).otherwise(F.col("stem")).alias("base"), F.when(is_numbered, number).otherwise(F.lit(0)).alias("number")
    )
    rows = rows.select(*FAMILY, "base", F.expr(f"number div {BLOCK}").alias("block"), F.expr(f"cast(number % {BLOCK} as int)").alias("number"))
    return rows.groupBy(*FAMILY, "base", "block").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*FAMILY), F.lit(buckets)).cast("int")


class NameIndex:
    """The names in the rows that a stream's batches have written below ``rows``, indexed below ``path``."""

    def __init__(self, ws: Workspace, path: str, rows: str) -> None:
        self.ws, self.spark, self.path, self.rows = ws, ws.spark, path.rstrip("/"), rows.rstrip("/")

    def _children(self, folder: str) -> Iterator[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return (s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else iter(())

    def _buckets(self, i: int) -> int | None:
        """How many buckets part i has, or None where it has not been written whole."""
        for name in self._children(f"{self.path}/part={i}"):
            if name.startswith("buckets=") and "_SUCCESS" in self._children(f"{self.path}/part={i}/{name}"):
                return int(name.removeprefix("buckets="))
        return None

    def part(self, i: int, families: DataFrame | None = None) -> DataFrame:
        """Rows of part i, of some staged ``families`` only where given: then only their buckets are read."""
        buckets = self._buckets(i)
        if buckets is None:
            raise FileNotFoundError(f"part {i} of {self.path}")
        rows = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/part={i}/buckets={buckets}")
        if families is not None:
            wanted = families.select(_bucket(buckets).alias("b")).distinct().collect()
            rows = rows.where(F.col("bucket").isin([r.b for r in wanted])).join(families, FAMILY, "left_semi")
        return rows.drop("bucket")

    def _build(self, i: int) -> None:
        source = f"{self.rows}/batch_id={i - 1}"
        names = empty(self.spark, "folder string, name string")
        if any(True for _ in self._children(source)):
            names = self.spark.read.schema("dst string").parquet(source).select(parent("dst").alias("folder"), file_name("dst").alias("name"))
        rows = _blocks(names)
        for p in merged_parts(i):
            rows = rows.unionByName(self.part(p))
        # A block's lists come from fewer parts than i has bits, and each is bounded.
        rows = rows.groupBy(*FAMILY, "base", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"))
        rows = self.ws.stage(rows, f"names-{i}")
        buckets = min(MOST_BUCKETS, max(1, -(-rows.count() // BUCKET_ROWS)))
        dealt = rows.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", *FAMILY)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/part={i}/buckets={buckets}")

    def refresh(self, n: int) -> None:
        """Write the parts that the names before batch n need; as a rule that is the last one."""
        needed, missing = parts_before(n), []
        while needed:
            i = needed.pop()
            if self._buckets(i) is None:
                missing.append(i)
                needed += merged_parts(i)
        for i in sorted(missing):
            self._build(i)

    def meeting(self, wanted: DataFrame, n: int) -> DataFrame:
        """``folder, name`` given before batch n that share a family with ``wanted`` rows ``folder, name``.

        A null folder or name meets nothing.
        """
        self.refresh(n)
        families = self.ws.stage(_families(wanted).select(*FAMILY).distinct(), "families")
        rows = empty(self.spark, SCHEMA)
        for i in parts_before(n):
            rows = rows.unionByName(self.part(i, families))
        given = rows.select("folder", "base", "ext", "block", F.explode("numbers").alias("number"))
        number = F.col("block") * BLOCK + F.col("number")
        mark = F.when(number > 0, F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(F.lit(""))
        return given.select("folder", F.concat("base", mark, "ext").alias("name"))
