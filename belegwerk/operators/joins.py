"""Joins that look at sizes before they pick a way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.workspace import measure

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 0.005
HOT_ROWS = 1_000_000
SALTS = 64


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``big`` to a staged lookup table.

    The lookup is broadcast only if its measured size is within ``limit``. Beyond that both sides
    are shuffled, and keys that hold a large share of ``big`` are spread over salted copies.
    """
    _, size = measure(small)
    if size <= limit:
        return big.join(F.broadcast(small), key, how)
    return salted_join(big, small, key, how)


def salted_join(
    big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi join that spreads the hot keys of ``big``; ``how`` is inner, left, left_semi or left_anti.

    A key is hot when it holds more than ``HOT_SHARE`` of the rows, so there are never more than
    ``1 / HOT_SHARE`` of them and their list fits into the plan. Null keys match nothing and are
    spread as well. Without either this is a plain join.
    """
    total, keyed = big.agg(F.count(F.lit(1)), F.count(key)).first()
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # Below that size one task takes a whole key with ease.
    floor = max(total * HOT_SHARE, HOT_ROWS)
    hot = [row[key] for row in counts.where(F.col("n") > floor).select(key).collect()]
    if not hot and keyed == total:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    no_salt = F.lit(0).cast("long")
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(salts))
    left = big.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), spread).otherwise(no_salt))
    copies = F.sequence(no_salt, F.lit(salts - 1).cast("long"))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, copies).otherwise(F.array(no_salt))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
