"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
BLANKS = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def null_safe(value: str | Column) -> Column:
    """A key that is never null: 'n' for null, else the value after an 's'."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit("s"), value.cast("string")), F.lit("n"))


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; -1 for a null key, which so is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def words(text: str | None) -> list[bytes]:
    """Runs of bytes outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased; null and empty give none.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is just what is wanted.
    """
    return text.encode().lower().split() if text else []


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow column one by one, so that a batch never stands there as Python objects."""
    for value in column:
        yield value.as_py()


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like ``names`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def partitions(df: DataFrame, least: int = 1) -> int:
    return max(least, df.rdd.getNumPartitions())


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` over all cores, whatever its keys, when its source has too few splits for them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
