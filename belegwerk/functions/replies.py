"""Replies of a metadata extractor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from belegwerk.functions.text import _col


def parse_reply(reply: Column | str) -> Column:
    """``struct<date, subject>`` of a JSON object that has both keys, else null.

    Arrays, broken JSON, single quotes, text before or after the object and objects with a missing
    key are all refused; empty values are kept. A lone parse stops at the end of the first value, so
    the reply is parsed as a member between two others: what follows it must be the second one.
    """
    r = _col(reply)
    framed = F.concat(F.lit('{"r":'), r, F.lit(',"end":1}'))
    whole = F.try_parse_json(framed).isNotNull() & (F.json_object_keys(framed) == F.array(F.lit("r"), F.lit("end")))
    keys = F.json_object_keys(r)
    complete = F.array_contains(keys, "date") & F.array_contains(keys, "subject")
    return F.when(whole & complete, F.from_json(r, "date string, subject string"))
