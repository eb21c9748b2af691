"""File names against a one-by-one simulation."""

import random

import pytest

from belegwerk.operators.naming import resolve_names
from belegwerk.operators.ranking import numbered, running_sum


def one_by_one(wanted, existing):
    taken = set(existing)
    out = {}
    for doc_id, folder, name in sorted(wanted):
        base, dot, ext = name.rpartition(".")
        free, k = name, 0
        while (folder, free) in taken:
            k += 1
            free = f"{base} ({k}).{ext}"
        taken.add((folder, free))
        out[doc_id] = free
    return out


def resolve(spark, ws, wanted, existing):
    docs = spark.createDataFrame(wanted, "doc_id long, folder string, name string")
    there = spark.createDataFrame(existing, "folder string, name string")
    return {r.doc_id: r.final_name for r in resolve_names(ws, docs, there).collect()}


def test_kth_free_number(spark, ws):
    existing = [("R", "a.pdf"), ("R", "a (1).pdf"), ("R", "a (3).pdf")]
    wanted = [(i, "R", "a.pdf") for i in range(3)]
    assert resolve(spark, ws, wanted, existing) == {0: "a (2).pdf", 1: "a (4).pdf", 2: "a (5).pdf"}


def test_folders_do_not_clash(spark, ws):
    wanted = [(1, "Review", "a.pdf"), (2, "Unsure", "a.pdf")]
    assert resolve(spark, ws, wanted, []) == {1: "a.pdf", 2: "a.pdf"}


@pytest.mark.parametrize("seed", range(4))
def test_names_that_end_in_numbers(spark, ws, seed):
    rng = random.Random(seed)
    names = ["a.pdf", "a (1).pdf", "a (2).pdf", "a (1) (1).pdf", "b.pdf", "b (2).pdf"]
    wanted = [(i, rng.choice(["R", "U"]), rng.choice(names)) for i in range(40)]
    existing = [("R", n) for n in rng.sample(["a.pdf", "a (3).pdf", "a (1).pdf", "b (1).pdf", "b.pdf"], 2)]
    assert resolve(spark, ws, wanted, existing) == one_by_one(wanted, existing)


def test_many_names_that_alternate(spark, ws):
    """Rounds follow the depth of the endings, not the rows: a, a (1), a, a (2) and so on."""
    wanted = [(i, "R", "a.pdf" if i % 2 == 0 else f"a ({i // 2 + 1}).pdf") for i in range(2000)]
    wanted += [(3000 + i, "R", f"a ({i % 7 + 1}) ({i % 5 + 1}).pdf") for i in range(60)]
    assert resolve(spark, ws, wanted, []) == one_by_one(wanted, [])


def test_hot_group_is_cut_into_slices(spark, ws):
    rows = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('g', id % 50) end as g")
    got = numbered(ws, rows, ["g"], ["id"], "n").collect()
    seen = {}
    for row in sorted(got, key=lambda r: r.id):
        seen[row.g] = seen.get(row.g, 0) + 1
        assert row.n == seen[row.g]
    total = running_sum(ws, rows, [], ["id"], rows.id, "s").collect()
    run = 0
    for row in sorted(total, key=lambda r: r.id):
        run += row.id
        assert row.s == run
