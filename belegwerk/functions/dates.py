"""Dates and months found in texts with built-in expressions."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.functions.text import BLANKS, _col

MONTH_YEAR = "(?iu)(" + "|".join(name for name, _ in settings.MONTHS) + rf")[{BLANKS}]*([0-9]{{4}})"


def _first_match(text: Column, pattern: str, then: Callable[[Column], Column]) -> Column:
    """``then`` of the first match, or null. The text is searched once; parts come from the short match.

    As a lambda's argument the match is worked out once, however often ``then`` uses it.
    """
    hit = F.regexp_substr(text, F.lit(pattern))
    return F.element_at(F.transform(F.array(hit), then), 1)


def _plausible(text: Column, pattern: str, year: int, month: int, day: int, newest: int) -> Column:
    pattern = pattern.replace(r"\s", f"[{BLANKS}]")

    def date_of(hit: Column) -> Column:
        y, m, d = (F.regexp_extract(hit, pattern, group) for group in (year, month, day))
        inside = y.try_cast("int").between(settings.OLDEST_YEAR, newest)
        return F.when(inside, F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d"))

    return _first_match(text, pattern, date_of)


def text_date(text: Column | str, as_of: datetime.date) -> Column:
    """First date of the text from 2000 to the year after ``as_of``; year-first dates go before others.

    Only the first match of each pattern counts, and digits are the ASCII ones.
    """
    t = _col(text)
    newest = as_of.year + 1
    return F.coalesce(
        _plausible(t, settings.YEAR_FIRST, 1, 2, 3, newest),
        _plausible(t, settings.DAY_FIRST, 3, 2, 1, newest),
    )


def month_exact(text: Column | str, as_of: datetime.date) -> Column:
    """``struct<month, year>`` of the first month name followed by a year, or null."""
    codes = F.create_map(*[F.lit(x) for pair in settings.MONTHS for x in pair])

    def month_of(hit: Column) -> Column:
        year = F.regexp_extract(hit, MONTH_YEAR, 2).try_cast("int")
        code = F.try_element_at(codes, F.lower(F.regexp_extract(hit, MONTH_YEAR, 1)))
        inside = code.isNotNull() & year.between(settings.OLDEST_YEAR, as_of.year + 1)
        return F.when(inside, F.struct(code.alias("month"), year.alias("year")))

    return _first_match(_col(text), MONTH_YEAR, month_of)


def reply_date(text: Column | str) -> Column:
    """Date of the form ``2024.1.31``, padded or not; anything else is null."""
    shape = _col(text).rlike(r"^[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}$")
    return F.when(shape, F.try_to_date(_col(text), "y.M.d"))
