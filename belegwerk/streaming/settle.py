"""Settling: work starts once an inbox has been quiet for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belegwerk import settings


def settle(events: DataFrame, gap_seconds: float = settings.SETTLE_SECONDS) -> DataFrame:
    """``inbox, first_event, settled_at, n_events`` of a table ``inbox, ts``.

    Events up to exactly the gap apart belong together; ``settled_at`` is the last event plus the
    gap. Events of one inbox within one slice of gap length always belong together, so each slice is
    reduced to a row before the sort. A busy inbox then costs one row per slice, however many events
    it has.
    """
    gap = round(gap_seconds * 1_000_000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slices = (
        events.select("inbox", micros.alias("at"))
        .groupBy("inbox", F.floor(F.col("at") / gap).alias("slice"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    in_order = Window.partitionBy("inbox").orderBy("slice")
    opens = F.coalesce(F.col("first") - F.lag("last").over(in_order) > gap, F.lit(True))
    marked = slices.withColumn("opens", opens.cast("long"))
    return (
        marked.withColumn("session", F.sum("opens").over(in_order))
        .groupBy("inbox", "session")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_events"))
        .select(
            "inbox",
            F.timestamp_micros("first").alias("first_event"),
            F.timestamp_micros(F.col("last") + gap).alias("settled_at"),
            "n_events",
        )
    )


def settle_stream(
    events: DataFrame,
    gap_seconds: float = settings.SETTLE_SECONDS,
    late: str = "0 seconds",
    clock: DataFrame | None = None,
) -> DataFrame:
    """``settle`` on a stream ``inbox, ts``: a session comes out once the watermark has passed its end.

    The watermark follows the newest time seen less ``late``. Events of a later micro-batch that are older
    than it are late and dropped. Without further input it stands still, and the last sessions of quiet
    inboxes would never come out. ``clock`` is a stream with a column ``ts`` of times that have passed (such
    as a rate source's, or one row at shutdown); its rows move the watermark and make no session.

    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` lets Spark merge the
    sessions of a busy inbox before the shuffle.
    """
    rows = events.select("inbox", "ts", F.lit(False).alias("tick"))
    if clock is not None:
        ticks = clock.select(F.lit(None).cast(events.schema["inbox"].dataType).alias("inbox"), "ts", F.lit(True).alias("tick"))
        rows = rows.union(ticks)
    window = F.session_window("ts", f"{round(gap_seconds * 1000)} milliseconds")
    return (
        rows.withWatermark("ts", late)
        .groupBy("inbox", "tick", window.alias("session"))
        # A condition on the key would be pushed below the watermark, and the clock's rows with it.
        .agg(F.count(F.lit(1)).alias("n_events"), F.max("tick").alias("is_tick"))
        .where("not is_tick")
        .select(
            "inbox",
            F.col("session.start").alias("first_event"),
            F.col("session.end").alias("settled_at"),
            "n_events",
        )
    )
