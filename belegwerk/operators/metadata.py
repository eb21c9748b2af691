"""Dates and subjects: extractor plug-ins and what fills the gaps."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.functions.dates import reply_date, text_date
from belegwerk.functions.replies import parse_reply
from belegwerk.functions.text import first_line_subject, present, prompt_text
from belegwerk.operators.text_cache import TextCache
from belegwerk.workspace import Workspace

# Prompts that are asked before their replies are stored.
REPLY_BATCH = 10_000


class Extractor:
    """User-supplied metadata extractor: text in, reply text (or None) out.

    ``setup`` and ``teardown`` run once per task around all its rows, also when one fails.
    """

    def setup(self) -> None:
        """Load what ``reply`` needs."""

    def reply(self, text: str) -> str | None:
        raise NotImplementedError

    def teardown(self) -> None:
        """Let go of what ``setup`` loaded."""


def extractor_reply(text: Column | str, make: Callable[[], Extractor]) -> Column:
    """Reply of an extractor for a text; it sees the prompt text only, and nothing for a null."""

    @F.pandas_udf("string")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extractor = make()
        extractor.setup()
        try:
            for batch in batches:
                yield pd.Series(
                    [None if t is None else extractor.reply(t) for t in batch], dtype=object
                )
        finally:
            extractor.teardown()

    return replies(prompt_text(text))


def extract_missing(docs: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """Add ``reply``: the extractor runs only where date or subject is still missing.

    The other rows hand it a null, so their texts are not sent to Python.
    """
    missing = F.col("date").isNull() | present("subject").isNull()
    return docs.withColumn("reply", extractor_reply(F.when(missing, F.col("text")), make))


def extract_stored(
    ws: Workspace, docs: DataFrame, make: Callable[[], Extractor], path: str, version: str = "1", batch: int = REPLY_BATCH
) -> DataFrame:
    """``extract_missing`` with a store of replies at ``path``: a prompt is asked once per ``version`` of the extractor.

    Equal prompts are asked once. New ones go to the extractor in slices of about ``batch``, and each
    slice is in the store before the next begins, so a run that fails or is replayed asks at most one slice
    again. No reply is kept as well, as an empty one, which is turned back into a null.
    """
    missing = F.col("date").isNull() | present("subject").isNull()
    prompt = F.when(missing, prompt_text("text"))
    marked = docs.withColumn("content_hash", F.md5(F.concat_ws("\n", F.lit(version), prompt).cast("binary")))
    marked = ws.stage(marked.withColumn("content_hash", F.when(prompt.isNotNull(), F.col("content_hash"))), "prompts")
    store = TextCache(ws.spark, path)
    new = ws.stage(store.misses(marked.select("content_hash", prompt_text("text").alias("prompt"))), "unasked")
    slices = -(-new.count() // batch)
    for i in range(slices):
        part = new.where(F.pmod(F.xxhash64("content_hash"), F.lit(slices)) == i)
        store = store.add(ws, part.select("content_hash", F.coalesce(extractor_reply("prompt", make), F.lit("")).alias("norm_text")))
    return store.with_text(ws, marked).withColumn("reply", F.nullif("norm_text", F.lit(""))).drop("norm_text", "content_hash")


def fill_date(
    docs: DataFrame, as_of: datetime.date, reply: Column | None = None, mtime: str = "mtime"
) -> DataFrame:
    """Fill a missing ``date`` from the reply, then the text, then the file's modification day."""
    sources = [F.col("date")]
    if reply is not None:
        sources.append(reply_date(reply["date"]))
    sources += [text_date("text", as_of), F.to_date(mtime)]
    return docs.withColumn("date", F.coalesce(*sources))


def fill_subject(docs: DataFrame, reply: Column | None = None) -> DataFrame:
    """Fill a missing ``subject`` from the reply, then the first line, then a constant.

    A subject that neither a rule nor the reply gave sets ``confidence`` to 0.
    """
    known = present("subject")
    if reply is not None:
        known = F.coalesce(known, present(reply["subject"]))
    fallback = F.coalesce(present(first_line_subject("text")), F.lit(settings.UNKNOWN_SUBJECT))
    return docs.withColumns(
        {
            "subject": F.coalesce(known, fallback),
            "confidence": F.when(known.isNotNull(), F.col("confidence")).otherwise(F.lit(0.0)),
        }
    )


def fill_metadata(docs: DataFrame, as_of: datetime.date) -> DataFrame:
    """Fill date and subject of rows that carry a ``reply`` text."""
    parsed = docs.withColumn("_reply", parse_reply("reply"))
    filled = fill_subject(fill_date(parsed, as_of, F.col("_reply")), F.col("_reply"))
    return filled.drop("_reply")
