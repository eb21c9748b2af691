"""Edge vectors of the text, date, path and reply expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from belegwerk.functions import dates, paths, replies
from belegwerk.functions import text as txt
from belegwerk.operators import metadata

AS_OF = datetime.date(2026, 1, 1)


def values(spark, expression, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, s string")
    return [r.v for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    got = values(spark, txt.normalize_text("s"), ["Für  Straße, 5²_x!", "", None, "\n--\t"])
    assert got == ["für straße 5²_x", "", "", ""]


def test_terms(spark):
    kept = txt.without_stop_words(txt.term_words(F.col("s")))
    got = values(spark, txt.word_pairs(kept), ["die rechnung alpha beta und gamma café ab", "alpha", ""])
    assert got == [["alpha beta", "beta gamma"], [], []]


@pytest.mark.parametrize(
    "text, day",
    [
        ("2024-13-45 und 01.02.2024", "2024-02-01"),
        ("01.02.1999 und 03.04.2024", None),
        ("03.04.2024 … 2023/5/6", "2023-05-06"),
        ("2024 - 2 / 3", "2024-02-03"),
        ("30.02.2024", None),
        ("01.01.2027", "2027-01-01"),
        ("01.01.2028", None),
        ("ohne Datum", None),
        ("", None),
    ],
)
def test_text_date(spark, text, day):
    [got] = values(spark, dates.text_date("s", AS_OF), [text])
    assert (got.isoformat() if got else None) == day


def test_month_exact(spark):
    got = values(
        spark,
        dates.month_exact("s", AS_OF),
        ["im MÄRZ 2024", "maerz2025", "Mai 1980", "auguſt 2024", "Mai 1999 Juni 2024", "nichts"],
    )
    assert [tuple(g) if g else None for g in got] == [("03", 2024), ("03", 2025), None, None, None, None]


def test_sanitize(spark):
    inputs = ["a:b/c  d", "***", "  x\t y ", "a\tb", "x" * 119 + " yz", "zwei  Blanks"]
    want = ["abc d", "No Subject", "x y", "a\tb", "x" * 119 + " ", "zwei Blanks"]
    assert values(spark, txt.sanitize("s"), inputs) == want


def test_build_name(spark):
    name = txt.build_name(F.lit(datetime.date(2024, 2, 3)), "s")
    assert values(spark, name, ["Rechnung: Mai"]) == ["2024.02.03 Rechnung Mai.pdf"]


def test_replies(spark):
    parsed = replies.parse_reply("s")
    inputs = ['{"date":"2024.1.2","subject":""}', '{"date":"x"}', "[1]", "nein", None, '{"date":null,"subject":3}']
    got = [tuple(g) if g else None for g in values(spark, parsed, inputs)]
    assert got == [("2024.1.2", ""), None, None, None, None, (None, "3")]
    days = values(spark, dates.reply_date("s"), ["2024.1.31", "2024.01.05", "24.1.5", "2024.2.30", "1985.7.1", ""])
    assert [d.isoformat() if d else None for d in days] == ["2024-01-31", "2024-01-05", None, None, "1985-07-01", None]


@pytest.mark.parametrize(
    "text, subject, name",
    [
        ("\n* * *\nTitel", "  ", "No Subject"),
        ("****\nTitel", "Unbekannt", "Unbekannt"),
        ("ab\n  Vertrag Nr. 5/x \nmehr", "Vertrag Nr 5x", "Vertrag Nr 5x"),
        ("", "Unbekannt", "Unbekannt"),
    ],
)
def test_fallback_subject(spark, text, subject, name):
    rows = spark.createDataFrame([(text, "", 0.9)], "text string, subject string, confidence double")
    row = metadata.fill_subject(rows).withColumn("name", txt.sanitize("subject")).first()
    assert (row.subject, row.name, row.confidence) == (subject, name, 0.0)


def test_known_subject_keeps_confidence(spark):
    rows = spark.createDataFrame([("t", " ", 0.9)], "text string, subject string, confidence double")
    assert metadata.fill_subject(rows).first().confidence == 0.9


def test_paths(spark):
    inputs = ["/root/a/b/x.tar.PDF", "/root/y.pdf", "/else/z.pdf", "/root/a/.hidden"]
    assert values(spark, paths.label_of("s", "/root"), inputs) == ["a/b", None, None, "a"]
    name = paths.file_name("s")
    assert values(spark, paths.stem(name), inputs) == ["x.tar", "y", "z", ".hidden"]
    assert values(spark, paths.suffix(name), inputs) == [".PDF", ".pdf", ".pdf", ""]
    assert values(spark, paths.is_pdf("s"), inputs) == [True, True, True, False]
