"""The stages of the pipeline and the whole of it, over the given small tables and odd ones."""

import corpus_pipeline
from belegwerk.llm import catalog, mixing, ppm
from pathlib import Path

import pytest

from test_decontaminate import plain_tiles
from test_simhash import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")
def test_stages(spark, ws):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, ws.stage(stage(spark, docs, SF_DIR), "stage")
        seen.append((name, before, docs))
        if name != "mixing":
            assert docs.columns == columns
    ids = [{r.doc_id for r in x[2].select("doc_id").collect()} for x in seen]
    assert ids[1] == ids[0] >= ids[2] >= ids[3] == ids[4]
    # One document of each class stays.
    given = {r.doc_id: r.text for r in seen[2][1].collect()}
    classes = plain_components({i: plain_fingerprint(t) for i, t in given.items()})
    assert ids[2] == set(classes.values())
    # No benchmark item is left, and nothing else went.
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text.lower().split() for r in seen[3][1].collect()}

    def holds(words):
        grams = {tuple(words[i : i + 5]) for i in range(len(words))}
        near = [i for i in items if len({tuple(i[k : k + 5]) for k in range(len(i) - 4)} & grams) * 2 > len(i)]
        return any(sum(n for *_, n in plain_tiles(i, words, 5)) >= 0.8 * len(i) for i in near)

    assert {d for d, w in texts.items() if not holds(w)} == ids[3]
    mixed = seen[4][2].collect()
    assert all(r.taken <= 3 * r["size"] for r in mixed)
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(mixed)


def test_stages_take_odd_rows(spark, ws, odd, none, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a text nobody has written so far")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = ws.stage(stage(spark, rows, str(tmp_path)), "odd")
            assert name == "mixing" or rows.columns == odd.columns


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 11))
    assert mixing.REPEATS == 3 and ppm.ORDER == 5
