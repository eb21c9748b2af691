"""The name index against all earlier rows, batch by batch."""

import random
import re

import pytest

from belegwerk.operators import name_index
from belegwerk.operators.name_index import NameIndex, merged_parts, parts_before
from belegwerk.operators.naming import resolve_names
from test_naming import one_by_one

NAMES = "folder string, name string"


def test_parts_cover_every_batch_once():
    held = {}
    for i in range(1, 200):
        held[i] = {i - 1}.union(*(held[p] for p in merged_parts(i)))
        assert sum(len(held[p]) for p in parts_before(i)) == i
        assert set().union(*(held[p] for p in parts_before(i))) == set(range(i))
        assert len(parts_before(i)) == bin(i).count("1")


def write(spark, out, batch_id, names):
    rows = spark.createDataFrame([(f"{f}/{n}",) for f, n in names], "dst string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")


def pairs(df):
    return sorted((r.folder, r.name) for r in df.collect())


def family(folder, name):
    base, dot, ext = name.rpartition(".")
    return folder, re.sub(r"( \([1-9][0-9]*\))+$", "", base), ext


def test_ten_batches_find_what_all_earlier_rows_hold(spark, ws, monkeypatch):
    monkeypatch.setattr(name_index, "BLOCK", 4)
    rng, out, taken = random.Random(3), ws.path("out"), []
    pool = ["a.pdf", "a (1).pdf", "a (2) (1).pdf", "b.pdf", "b (3).pdf", "c.pdf", " (1).pdf", "a (0).pdf", "a (01).pdf"]
    index = NameIndex(ws, f"{out}/names", f"{out}/rows")
    built, build = [], index._build
    monkeypatch.setattr(index, "_build", lambda i: (built.append(i), build(i)))
    for batch in range(10):
        wanted = [(i, rng.choice(["/r/R", "/r/U"]), rng.choice(pool)) for i in range(4)]
        docs = spark.createDataFrame([w[1:] for w in wanted], NAMES)
        families = {family(*w[1:]) for w in wanted}
        assert pairs(index.meeting(docs, batch)) == sorted(t for t in taken if family(*t) in families)
        # Each batch adds one part and reads at most three, whatever came before it.
        assert built == list(range(1, batch + 1)) and len(parts_before(batch)) <= 3
        new = one_by_one(wanted, taken)
        new = [(folder, new[i]) for i, folder, _ in wanted]
        taken += new
        write(spark, out, batch, new)


def test_only_families_that_are_wanted(spark, ws):
    out = ws.path("out")
    write(spark, out, 0, [("/r", "a.pdf"), ("/r", "a (1).pdf"), ("/r", "a (1) (2).pdf"), ("/r", "b.pdf"), ("/s", "a.pdf"), ("/r", "a.txt")])
    wanted = spark.createDataFrame([("/r", "a (7).pdf"), (None, "a.pdf"), ("/r", None)], NAMES)
    index = NameIndex(ws, f"{out}/names", f"{out}/rows")
    assert pairs(index.meeting(wanted, 1)) == [("/r", "a (1) (2).pdf"), ("/r", "a (1).pdf"), ("/r", "a.pdf")]
    assert index.meeting(wanted.limit(0), 1).count() == 0
    assert index.meeting(wanted, 0).count() == 0


def test_gaps_copies_and_parts_that_are_missing(spark, ws):
    """A batch without rows, a name written twice, and an index begun late or left half-written."""
    out = ws.path("out")
    for batch, names in ((0, ["a.pdf", "a.pdf"]), (1, ["a (1).pdf"]), (3, ["a (5000).pdf", "a.pdf"])):
        write(spark, out, batch, [("/r", n) for n in names])
    spark.range(1).write.parquet(f"{out}/names/part=4/half")
    wanted = spark.createDataFrame([("/r", "a.pdf")], NAMES)
    index = NameIndex(ws, f"{out}/names", f"{out}/rows")
    expected = [("/r", "a (1).pdf"), ("/r", "a (5000).pdf"), ("/r", "a.pdf")]
    assert sorted(set(pairs(index.meeting(wanted, 4)))) == expected
    assert sorted(set(pairs(NameIndex(ws, f"{out}/names", f"{out}/rows").meeting(wanted, 5)))) == expected


def test_a_hot_name_is_few_rows(spark, ws):
    out = ws.path("out")
    rows = spark.range(20_000).selectExpr("concat('/r/a', if(id = 0, '', concat(' (', id, ')')), '.pdf') AS dst")
    rows.write.parquet(f"{out}/rows/batch_id=0")
    index = NameIndex(ws, f"{out}/names", f"{out}/rows")
    index.refresh(1)
    assert index.part(1).count() == 5
    docs = spark.createDataFrame([(1, "/r", "a.pdf"), (2, "/r", "a (3).pdf")], "doc_id long, folder string, name string")
    got = resolve_names(ws, docs, index.meeting(docs, 1))
    assert {r.doc_id: r.final_name for r in got.collect()} == {1: "a (20000).pdf", 2: "a (3) (1).pdf"}


@pytest.mark.parametrize("n", [0, 1, 6])
def test_parts_before(n):
    assert parts_before(n) == {0: [], 1: [1], 6: [6, 4]}[n]
