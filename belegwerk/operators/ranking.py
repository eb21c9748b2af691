"""Running totals and row numbers within groups, where one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belegwerk.workspace import Workspace


def running_sum(
    ws: Workspace,
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group up to and including this one.

    A plain window puts a whole group into one task. Here the rows are range-partitioned by group
    and order, so a hot group is cut into even slices. Each slice is summed on its own and shifted
    by the total of the slices before it. ``order`` must be unique within a group.
    """
    cut = df.withColumn("_value", value.cast("long")).repartitionByRange(*groups, *order)
    cut = ws.stage(cut.withColumn("_slice", F.spark_partition_id()), "slices")
    keys = [*groups, "_slice"]
    before = (
        Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        cut.groupBy(*keys)
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_shift", F.sum("_total").over(before))
        .where("_shift is not null")
        .drop("_total")
    )
    # A group that goes on into a slice has filled the one before, so each slice border is crossed
    # by one group at most: there are fewer shifts than slices.
    within = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.withColumn("_run", F.sum("_value").over(within))
        .join(F.broadcast(shifts), keys, "left")
        .withColumn(out, F.col("_run") + F.coalesce("_shift", F.lit(0)))
        .drop("_value", "_slice", "_run", "_shift")
    )


def numbered(
    ws: Workspace, df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    """Add a row number from 1 within each group, by a unique ``order``."""
    return running_sum(ws, df, groups, order, F.lit(1), out)
