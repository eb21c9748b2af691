import random
from collections import Counter

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from belegwerk.llm import catalog, line_dedup


def brute(rows, ratio, least):
    pages, lines = Counter(), Counter()
    for _, text, source in rows:
        pages[source] += 1
        lines.update({(source, line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")})
    out = []
    for doc, text, source in rows:
        if not text:
            out.append((doc, text, 0, 0))
            continue
        parts = text.split("\n")
        bad = [p.strip(" \t\n\x0b\x0c\r") for p in parts]
        kept = [p for p, b in zip(parts, bad) if not b or not (lines[source, b] >= least and lines[source, b] > ratio * pages[source])]
        out.append((doc, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def rows(n=300):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(400)]
    out = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["a", "b", None])
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        lines += ["Menu"] * (rng.random() < 0.3) + [f" Imprint {source} "] * (rng.random() < 0.12) + [""]
        rng.shuffle(lines)
        out.append((i, "\n".join(lines) if rng.random() < 0.95 else None, source))
    return out + out[:5]


def test_same_as_counting(spark, ws):
    data = rows()
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    for ratio, least in ((0.1, 5), (0.02, 2)):
        got = line_dedup.drop_boilerplate(ws, frame, ratio=ratio, min_pages=least)
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
        assert got == brute(data, ratio, least)


def test_sql_twin(spark, ws, tmp_path):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    path = str(tmp_path / "documents")
    frame.write.parquet(path)
    got = line_dedup.drop_boilerplate(ws, frame, merge_copies=True).select("doc_id", "n_lines", "n_dropped", "text").collect()
    want = duckdb.sql(line_dedup.SQL.replace("FROM documents", f"FROM '{path}/*.parquet'")).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_odd_rows(ws, odd, none):
    got = line_dedup.drop_boilerplate(ws, odd, min_pages=1, ratio=0.9)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert sorted(map(str, got.select(*odd.columns).collect()))  # every row is there
    assert got.count() == odd.count() and got.where("text is null").count() == odd.where("text is null").count()
    assert {r._host for r in got.collect()} == {"h"}
    assert line_dedup.drop_boilerplate(ws, none).count() == 0


def test_copies_are_one_page(spark, tmp_path):
    copy = "\n".join(f"own line {k}" for k in range(6)) + "\nMenu"
    data = [(i, copy, "s") for i in range(20)] + [(100 + i, f"text {i}\nMenu", "s") for i in range(40)]
    data += [(200 + i, f"few {i % 2}\nof a small source", "t") for i in range(10)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    path = str(tmp_path)
    frame.write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in catalog.op7_line_dedup(spark, path).collect()}
    staged = corpus_pipeline.drop_lines(spark, frame.withColumn("n_chars", F.length("text").cast("long")), path)
    assert {r.doc_id: r.text for r in staged.collect()} == {i: t for i, (t, _) in got.items()}
    # A third of the source are copies: they lose the menu only, which 41 different pages carry.
    assert all(got[i] == (copy.removesuffix("\nMenu"), 1) for i in range(20))
    assert all(got[100 + i] == (f"text {i}", 1) for i in range(40))
    assert all(got[i] == (t, 0) for i, t, s in data if s == "t")


def test_near_copies_keep_their_lines(spark, ws):
    shared = [f"a line of the article, number {k}" for k in range(3)]
    data = [(i, "\n".join([*shared, f"a fourth line that differs, {i}", "Menu"]), "s") for i in range(10)]
    data += [(100 + i, f"an article of its own, number {i}\nand more of it, {i}\nMenu", "s") for i in range(20)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(ws, frame, merge_copies=True).collect()}
    # The ten near copies are a third of the source; the menu goes from them as from all pages.
    assert got == {i: (t.removesuffix("\nMenu"), 1) for i, t, _ in data}
