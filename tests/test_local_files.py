"""Folders of very many files: the rows of Spark's reader, and nothing per file in the driver."""

import pytest
from pyspark.sql import functions as F

from belegwerk.plans import derived
from belegwerk.plans.derived import Tables
from belegwerk.sources import files as src
from belegwerk.sources.local_files import InboxReader
from belegwerk.streaming import intake

NAMES = ("empty.pdf", "a.pdf", "b ä%20.PDF", "c+1.pDf", "sub/d.pdf", "sub/year=2024/e.pdf", "_x=1/f.pdf", "note.txt", "pdf", ".g.pdf", "_h.pdf", "i.pdf._COPYING_", ".sub/j.pdf", "_sub/k.pdf")


def test_a_listed_folder_has_the_rows_of_sparks_reader(spark, tmp_path, monkeypatch):
    for i, name in enumerate(NAMES):
        (tmp_path / "in box" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in box" / name).write_bytes(b"x" * i)
    (tmp_path / "in box" / "dead.pdf").symlink_to(tmp_path / "nothing")
    root = f"{tmp_path}/in box/"
    for scan in (src.scan_inbox, src.scan_corpus):
        monkeypatch.setattr(src, "DRIVER_FILES", 1000)
        wanted = scan(spark, root)
        monkeypatch.setattr(src, "DRIVER_FILES", 2)
        got = scan(spark, root)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and got.schema == wanted.schema
        assert sorted(got.collect()) == sorted(wanted.collect())
    # Contents are opened only where they are used, and only of the rows that are left.
    (tmp_path / "in box" / "a.pdf").unlink()
    files = scan(spark, root)
    (tmp_path / "in box" / "c+1.pDf").unlink()
    assert files.select("path").count() == 5
    other = files.where("path like '%d.pdf'").select("path")
    assert [r.length for r in files.join(other, "path", "left_semi").where("content is not null").collect()] == [4]


def test_a_log_has_each_file_once(tmp_path):
    inbox, log = tmp_path / "in", tmp_path / "log"
    inbox.mkdir()
    log.mkdir()

    def names(reader, start, end):
        parts = reader.partitions({"version": start}, {"version": end})
        return sorted(p.rsplit("/", 1)[1] for part in parts for batch in reader.read(part) for p in batch.column(0).to_pylist())

    reader = InboxReader(str(inbox), str(log), 3)
    assert reader.initialOffset() == reader.latestOffset() == {"version": 0}
    for i in range(10):
        (inbox / f"{i}.pdf").write_text("x")
    assert reader.latestOffset() == reader.latestOffset() == {"version": 1}
    assert len(reader.partitions({"version": 0}, {"version": 1})) == 3
    (inbox / "new.pdf").write_text("x")
    (inbox / "0.pdf").unlink()
    (log / ".left over").mkdir()
    # A restart, which knows of the first version by the log only.
    late = InboxReader(str(inbox), str(log), 3)
    assert late.latestOffset() == {"version": 2}
    assert names(late, 1, 2) == ["new.pdf"] and names(late, 0, 1) == [f"{i}.pdf" for i in range(10)]
    assert len(names(reader, 0, 2)) == 11


def test_a_stream_keeps_no_file_in_the_driver(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    seen = []

    def process(batch, batch_id):
        seen.append(sorted((r.path.rsplit("/", 1)[1], bytes(r.content), r.length) for r in batch.collect()))
        if len(seen) == 1:
            raise RuntimeError("broken batch")
        return batch.select("path")

    def run():
        intake.start(src.watch_inbox(spark, str(inbox)), process, str(out)).awaitTermination()

    (inbox / "a.pdf").write_text("1")
    with pytest.raises(Exception, match="broken batch"):
        run()
    (inbox / "b ä.PDF").write_text("22")
    run()
    run()
    # The failed batch comes again as it was, then what has come since.
    assert seen == [[("a.pdf", b"1", 1)], [("a.pdf", b"1", 1)], [("b ä.PDF", b"22", 2)]]
    assert not any("a.pdf" in p.read_text(errors="replace") for p in (out / "checkpoint").rglob("*") if p.is_file())


def test_a_stream_goes_on_without_an_end(spark, tmp_path):
    import time

    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.pdf").write_text("1")
    query = intake.start(src.watch_inbox(spark, str(inbox)), lambda batch, i: batch.select("path"), out, available_now=False)
    try:
        query.processAllAvailable()
        (inbox / "b.pdf").write_text("2")
        until = time.time() + 60
        while time.time() < until and len(list((tmp_path / "out" / "metrics").glob("batch_id=1/_SUCCESS"))) < 1:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(r.path[-5:] for r in intake.sink_rows(spark, out).collect()) == ["a.pdf", "b.pdf"]


def test_an_older_checkpoint_keeps_its_source(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.pdf").write_text("1")
    plain = src.watch_inbox(spark, str(inbox)).select("*")
    intake.start(plain, lambda batch, i: batch.select("path"), out).awaitTermination()
    (inbox / "b.pdf").write_text("2")
    intake.start(src.watch_inbox(spark, str(inbox)), lambda batch, i: batch.select("path"), out).awaitTermination()
    assert sorted((r.path[-5:], r.batch_id) for r in intake.sink_rows(spark, out).collect()) == [("a.pdf", 0), ("b.pdf", 1)]


def test_files_are_written_as_spark_writes_them(spark, tmp_path, monkeypatch):
    odd = "b c#%'*/:=?\\{}[]^\"\x01é "
    rows = [(1, "a", None, "x"), (2, "", odd, "y"), (3, "c", "d", None), (4, "c", "d", "z")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables = Tables(spark, str(tmp_path))
    new = tables.document_folder()
    monkeypatch.setattr(derived, "local_folder", lambda spark, root: None)
    old = tables.document_folder()

    def found(root):
        files = src.scan_corpus(spark, root).select("path", "content").collect()
        return sorted((r.path.removeprefix("file:").removeprefix(root).rsplit("/", 1)[0], bytes(r.content)) for r in files)

    assert found(new) == found(old) and len(found(new)) == 3
    assert src.scan_review(spark, new).count() == src.scan_review(spark, old).count() == 3
    tables.write_files(spark.createDataFrame([("x",)], "line string"), old, "txt")
    monkeypatch.undo()
    tables.write_files(spark.createDataFrame([("y",)], "line string"), new, "txt")
    assert sorted(r.n for r in src.scan_review(spark, new).groupBy(F.right("path", F.lit(4)).alias("end")).agg(F.count("*").alias("n")).collect()) == [1, 3]
