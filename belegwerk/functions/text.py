"""Text expressions: normalising, terms, subjects and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from belegwerk import settings

# Blanks of any script, as a Java character class body.
BLANKS = r"\s\x1c-\x1f\x85\p{Z}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-cased word runs, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(settings.WORD_PATTERN), F.lit(0))


def normalize_text(text: Column | str) -> Column:
    """Lower-case word runs joined by one blank; null gives an empty text."""
    return F.array_join(words(F.coalesce(_col(text), F.lit(""))), " ")


def long_enough(norm: Column | str, more_than: int = settings.MIN_TEXT) -> Column:
    return F.length(F.trim(_col(norm))) > more_than


def term_words(norm: Column | str) -> Column:
    """Words of a normalised text that may become terms, stop words included."""
    whole = rf"^{settings.TERM_PATTERN}$"
    return F.filter(F.split(_col(norm), " "), lambda w: w.rlike(whole))


def without_stop_words(tokens: Column | str, stop_words=settings.STOP_WORDS) -> Column:
    return F.filter(_col(tokens), lambda w: ~w.isin(*stop_words))


def word_pairs(tokens: Column | str) -> Column:
    """Neighbouring tokens joined by a blank."""
    t = _col(tokens)
    first = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
    second = F.slice(t, F.lit(2), F.size(t))
    return F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b))


def strip_blanks(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def sanitize(subject: Column | str) -> Column:
    """A subject that may stand in a file name."""
    s = F.regexp_replace(_col(subject), r'[:\\/<>|"?*\n\r]+', "")
    s = strip_blanks(F.regexp_replace(s, rf"[{BLANKS}]{{2,}}", " "))
    s = F.substring(s, 1, settings.NAME_CHARS)
    return F.when(F.length(s) > 0, s).otherwise(F.lit(settings.NO_SUBJECT))


def build_name(date: Column | str, subject: Column | str) -> Column:
    day = F.date_format(_col(date), "yyyy.MM.dd")
    return F.concat(day, F.lit(" "), sanitize(subject), F.lit(".pdf"))


def first_line_subject(text: Column | str) -> Column:
    """First line of more than three characters, reduced to safe ones; null if there is no such line."""
    stripped = F.transform(F.split(_col(text), "\n"), strip_blanks)
    line = F.try_element_at(F.filter(stripped, lambda s: F.length(s) > 3), F.lit(1))
    return F.substring(F.regexp_replace(line, r"[^\p{L}\p{N} _-]", ""), 1, settings.LINE_CHARS)


def prompt_text(text: Column | str) -> Column:
    """What an extractor gets to see: the opening of the document."""
    return F.substring(_col(text), 1, settings.PROMPT_CHARS)


def keyword_subject(text: Column | str, pairs) -> Column:
    """Subject of the first keyword found, case kept; null if none is."""
    subject = None
    for word, name in pairs:
        hit = _col(text).contains(word)
        subject = F.when(hit, F.lit(name)) if subject is None else subject.when(hit, F.lit(name))
    return F.lit(None).cast("string") if subject is None else subject


def present(value: Column | str) -> Column:
    """The value, or null where it is an empty text."""
    return F.nullif(_col(value), F.lit(""))
