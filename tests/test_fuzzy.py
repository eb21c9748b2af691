"""Fuzzy functions: known cases, and the kernels against plain dynamic programming."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from belegwerk.functions import fuzzy
from belegwerk.operators.rules import apply_rules, month_year
from belegwerk.settings import FUND_FOLDER, PAYROLL_FOLDER, JobSettings

AS_OF = datetime.date(2026, 1, 1)


@pytest.mark.parametrize(
    "text, pattern, expected",
    [
        ("Abrechnung derBrutto/Netto-Bezüge fürMai2026", "Abrechnung der Brutto", True),
        ("CANWay technol ogyGmbH Abrechnung der Brutto", "CANWay Technology GmbH", True),
        ("Rechnung nicht von Canway GmbH", "CANWay Technology GmbH", False),
        ("", "x", False),
        ("x", "", False),
        (None, "x", False),
    ],
)
def test_contains(spark, text, pattern, expected):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(fuzzy.fuzzy_contains("text", pattern, 0.80)).first()[0] is expected


def test_match_and_find(spark):
    rows = spark.createDataFrame([("Abrechnng der Brutto",), ("xx abrechnung yy",), ("***",)], "text string")
    match = [r[0] for r in rows.select(fuzzy.fuzzy_match("text", "Abrechnung der Brutto", 0.95)).collect()]
    assert match == [True, False, False]
    spans = [r[0] for r in rows.select(fuzzy.fuzzy_find("text", "Abrechnung", 0.95)).collect()]
    assert [tuple(s) if s else None for s in spans] == [None, (3, 13), None]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Abrechnung Mai 2026", ("05", 2026)),
        ("Abrechnung der Brutto Mai2026", ("05", 2026)),
        ("Abrechnung der Brutto Maii 2026", ("05", 2026)),
        ("Abrechnung Mai 1980", None),
        ("Mai 1980 und Junni 2024", ("05", 2024)),
        ("Junni 2024", ("06", 2024)),
        ("", None),
    ],
)
def test_month_year(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "text string")
    found = month_year(rows, AS_OF).first().found
    assert (tuple(found) if found else None) == expected


def test_rules(spark):
    rows = [
        (1, PAYROLL_FOLDER, "Abrechnung derBrutto/Netto-Bezüge fürMai2026"),
        (2, PAYROLL_FOLDER, "Abrechnung der Brutto ohne Monat"),
        (3, PAYROLL_FOLDER, "Meldebescheinigung zurSozialversicherung Mai 2024 Abrechnung der Brutto"),
        (4, FUND_FOLDER, "Quartalsbericht ERTRAGSAUSSCHÜTTUNG"),
        (5, FUND_FOLDER, "quartalsbericht"),
        (6, "anderswo", "Quartalsbericht Abrechnung der Brutto Mai 2024"),
        (7, None, "Quartalsbericht"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, subfolder string, text string")
    got = {r.doc_id: r.rule_subject for r in apply_rules(docs, JobSettings().rules, AS_OF).collect()}
    assert got == {
        1: "Abrechnung Canway 2026.05",
        2: None,
        3: "Meldebescheinigung zur Sozialversicherung",
        4: "Ertragsausschüttung",
        5: None,
        6: None,
        7: None,
    }


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    total = len(a) + len(b)
    return (1 - (total - 2 * common(a, b)) / total) * 100 if total else 100.0


def part(a, b):
    if not a or not b:
        return 100.0 if len(a) == len(b) else 0.0
    if len(a) == len(b):
        return max(windows(a, b), windows(b, a))
    return windows(*sorted((a, b), key=len))


def windows(short, long):
    m, n = len(short), len(long)
    parts = [long[i : i + m] for i in range(n - m + 1)]
    parts += [long[:k] for k in range(1, m)] + [long[n - k :] for k in range(1, m)]
    return max(ratio(short, p) for p in parts)


def find(text, pattern, cutoff):
    m = len(pattern)
    for width in range(max(1, m - 2), m + 4) if m else ():
        for start in range(len(text) - width + 1):
            if ratio(text[start : start + width], pattern) >= cutoff:
                return start, start + width
    return -1, -1


TEXT = st.text(alphabet="abä ", max_size=24)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4), st.text(alphabet="abä ", max_size=9))
def test_kernels(texts, pattern):
    assert fuzzy.whole_ratio(texts, pattern).tolist() == pytest.approx([ratio(t, pattern) for t in texts])
    assert fuzzy.part_ratio(texts, pattern).tolist() == pytest.approx([part(t, pattern) for t in texts])
    assert [tuple(s) for s in fuzzy.first_span(texts, pattern, 70).tolist()] == [find(t, pattern, 70) for t in texts]


def test_pattern_of_several_limbs():
    pattern, text = "abcä" * 35, "xabcäab" * 40
    assert fuzzy.part_ratio([text], pattern)[0] == pytest.approx(part(text, pattern))
    assert fuzzy.whole_ratio([text], pattern)[0] == pytest.approx(ratio(text, pattern))


def test_many_short_texts_go_in_step():
    """Texts shorter than the pattern are compared by length, not one by one."""
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdef "), rng.integers(1, 14))) for _ in range(20_000)]
    begin = time.perf_counter()
    got = fuzzy.part_ratio(texts, "abc def fade bead cab")
    assert time.perf_counter() - begin < 10
    for i in range(0, 20_000, 997):
        assert got[i] == pytest.approx(fuzzy._best_window(["abc def fade bead cab"], texts[i])[0])
