"""Subject rules: ordered, guarded by subfolder, a later hit replaces an earlier one."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.functions.dates import month_exact
from belegwerk.functions.fuzzy import fuzzy_contains, month_fuzzy
from belegwerk.settings import Rule


def month_year(
    docs: DataFrame,
    as_of: datetime.date,
    threshold: float = 0.85,
    text: str = "text",
    out: str = "found",
) -> DataFrame:
    """Add ``struct<month, year>``: the exact month name, else a misspelt one near a year.

    The fuzzy function gets a null instead of the text where there is an exact hit or no plausible
    year, so those texts never leave the JVM. A guard around the call would not keep them from it.
    """
    newest = as_of.year + 1
    years = F.regexp_extract_all(F.col(text), F.lit("[0-9]{4}"), F.lit(0))
    plausible = F.exists(years, lambda y: y.cast("int").between(settings.OLDEST_YEAR, newest))
    exact = docs.withColumn("_exact", month_exact(text, as_of))
    left_over = F.when(F.col("_exact").isNull() & plausible, F.col(text))
    found = F.coalesce("_exact", month_fuzzy(left_over, as_of, threshold))
    return exact.withColumn(out, found).drop("_exact")


def _fill(template: str, found: Column) -> Column:
    value = F.replace(F.lit(template), F.lit("{year}"), found["year"].cast("string"))
    return F.replace(value, F.lit("{month}"), found["month"])


def apply_rules(
    docs: DataFrame, rules: Sequence[Rule], as_of: datetime.date, out: str = "rule_subject"
) -> DataFrame:
    """Add the subject that the rules give, null if none fires. Needs ``subfolder`` and ``text``.

    The rules are a short list of the job, so they become one expression instead of a join. Texts of
    folders without a fuzzy rule are nulled before the fuzzy functions, and a month is only looked
    for where the phrase of a monthly rule was found.
    """
    rows = docs
    hits: dict[int, Column] = {}
    values: dict[int, Column] = {}
    helpers: list[str] = []
    for r in rules:
        here = F.col("subfolder") == r.subfolder
        values[r.rule_order] = F.lit(r.template)
        if r.kind == "keyword":
            hits[r.rule_order] = here & F.col("text").contains(r.pattern)
        elif r.kind in ("phrase", "monthly"):
            name = f"_hit_{r.rule_order}"
            rows = rows.withColumn(name, fuzzy_contains(F.when(here, F.col("text")), r.pattern, r.threshold))
            hits[r.rule_order] = F.col(name)
            helpers.append(name)
        else:
            raise ValueError(f"unknown rule kind {r.kind!r}")
    monthly = [r for r in rules if r.kind == "monthly"]
    for threshold in sorted({r.month_threshold for r in monthly}):
        group = [r for r in monthly if r.month_threshold == threshold]
        name = f"_month_{group[0].rule_order}"
        wanted = reduce(or_, [hits[r.rule_order] for r in group])
        rows = month_year(
            rows.withColumn("_dated", F.when(wanted, F.col("text"))), as_of, threshold, "_dated", name
        ).drop("_dated")
        helpers.append(name)
        for r in group:
            hits[r.rule_order] = hits[r.rule_order] & F.col(name).isNotNull()
            values[r.rule_order] = _fill(r.template, F.col(name))
    subject = F.lit(None).cast("string")
    taken: dict[str, Column] = {}
    for r in sorted(rules, key=lambda r: r.rule_order):
        fires = F.coalesce(hits[r.rule_order], F.lit(False))
        if r.group:
            earlier = taken.get(r.group)
            taken[r.group] = fires if earlier is None else earlier | fires
            fires = fires if earlier is None else fires & ~earlier
        subject = F.when(fires, values[r.rule_order]).otherwise(subject)
    return rows.withColumn(out, subject).drop(*helpers)
