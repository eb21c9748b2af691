import re
from collections import defaultdict

import duckdb
import pytest

from belegwerk.llm import licenses
from belegwerk.llm.license_texts import FULL_TEXTS

MIT = next(text for name, text in FULL_TEXTS if name == "MIT")
LINES = [
    "Released under the MIT License.",
    "released UNDER the  mit-license!",
    "Released under the MIT License and the MIT License too",
    "Licensed under the Apache License, Version 2.0. Licensed under the Apache License",
    "This work is licensed under the GNU General Public License, version 2.",
    "under the",
    "Licensed under CC BY-NC 4.0",
    "a plain line of words that has nothing to do with it",
    "",
    "of the of the software is provided in the software",
]


def words(text):
    return re.sub("[^a-zA-Z0-9]+", " ", text or "").strip(" ").lower().split(" ")


def pairs(text):
    w = words(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(text, dice=licenses.DICE):
    """Score and first word per license, from every window of every template."""
    mine, out = pairs(text), {}
    for name, wording in licenses.TEMPLATES:
        theirs = pairs(wording)
        grams = set(theirs)
        for start in range(len(mine)):
            if mine[start] not in grams:
                continue
            for length in (len(theirs), int(len(grams) * (2 - dice) / dice + 1e-9)):
                window = mine[start : start + length]
                while window[-1] not in grams:
                    window.pop()
                score = 2.0 * len(set(window) & grams) / (len(set(window)) + len(grams))
                if score >= dice:
                    out[name] = min(out.get(name, (0.0, 0)), (-score, start))
    return {(name, -minus, start) for name, (minus, start) in out.items()}


def scanned(ws, frame, **options):
    got = defaultdict(set)
    for r in licenses.scan(ws, frame, **options).collect():
        got[r.doc_id].add((r.license, r.score, r.word))
    return got


def test_same_as_brute_force_and_sql(spark, ws, tmp_path, monkeypatch):
    texts = ["\n".join(LINES[i % len(LINES) :: 1 + i % 3]) for i in range(40)]
    texts += [MIT, f"Some words before. {MIT} And after.", MIT[:400], MIT[:700] + " a few words between " + MIT[700:], None]
    texts += [" ".join(text.split()[::-1]) for _, text in FULL_TEXTS[:2]] + [text for _, text in FULL_TEXTS]
    data = list(enumerate(texts))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    expected = {i: brute(t) for i, t in data}
    assert scanned(ws, frame) == {i: hits for i, hits in expected.items() if hits}
    got = {r.doc_id: (r.license, r.score, r.n_hits) for r in licenses.licensed(ws, frame).collect()}
    best = {i: min((-score, name) for name, score, _ in hits) if hits else None for i, hits in expected.items()}
    assert got == {i: (b[1], -b[0], len(expected[i])) if b else (None, None, 0) for i, b in best.items()}
    path = str(tmp_path / "documents")
    frame.write.parquet(path)
    sql = licenses.SQL.replace("FROM documents", f"FROM '{path}/*.parquet'")
    assert {r[0]: tuple(r[1:]) for r in duckdb.sql(sql).fetchall()} == got


@pytest.mark.parametrize(
    ("text", "license"),
    [
        (MIT, "MIT"),
        ("# Copyright 2020 Somebody\n#\n# " + "\n# ".join(MIT.split("\n")) + "\nimport os", "MIT"),
        ("Licensed under the Apache License,\nVersion 2.0.", "Apache-2.0"),
        ("Licensed under the MIT License.", "MIT"),
        ("This page is about birds. Released under the MIT License. It has seen many of them.", "MIT"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-SA-4.0"),
        ("We talked of the license of the software for some time.", None),
        ("The MIT is a school; under the license plate there was another one.", None),
    ],
)
def test_what_is_found(spark, ws, text, license):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.licensed(ws, frame).first().license == license


def test_windows_across_chunks(spark, ws, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 50)
    data = [(i, "word " * i + MIT + " Licensed under CC BY 4.0.") for i in (0, 10, 49, 50, 51, 180)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert scanned(ws, frame) == {i: brute(t) for i, t in data}


def test_long_text_and_repeated_rows(spark, ws):
    data = [(1, "of the software " * 200_000 + "Released under the MIT License."), (2, "x"), (2, "Released under the MIT License.")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    rows = sorted((r.doc_id, r.license, r.n_hits) for r in licenses.licensed(ws, frame).collect())
    assert rows == [(1, "MIT", 1), (2, "MIT", 1), (2, "MIT", 1)]
    assert [r.word for r in licenses.scan(ws, frame).where("doc_id = 1").collect()] == [600_000]


def test_odd_rows(ws, odd, none):
    assert licenses.licensed(ws, odd).count() == odd.count()
    assert licenses.licensed(ws, odd).where("n_hits > 0").count() == 0
    assert licenses.licensed(ws, none).count() == 0
    assert licenses.scan(ws, odd, templates=()).count() == 0


@pytest.mark.parametrize("dice", [0.5, 0.95])
def test_thresholds(spark, ws, dice):
    data = list(enumerate(LINES))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert scanned(ws, frame, dice=dice) == {i: hits for i, t in data if (hits := brute(t, dice))}
