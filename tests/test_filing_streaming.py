"""Manifests, promotion, cache, readers and streams."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from belegwerk.operators import filing, text_cache
from belegwerk.operators.metadata import Extractor, extract_missing
from belegwerk.sources import files as src
from belegwerk.streaming import intake, settle


def manifest(spark, ws, mode):
    rows = [
        (1, "/in/Steuer 1.pdf", "Review", "Review", "a", "n.pdf"),
        (2, "/in/x.pdf", "Review", "Review", "a", "n.pdf"),
        (3, "/in/TAX.pdf", "Unsure", "Unsure", "", "n.pdf"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, bucket string, root string, subfolder string, name string")
    there = spark.createDataFrame([("Review/a", "n (1).pdf")], "folder string, name string")
    return filing.manifest(ws, docs, there, mode)


def test_manifest_and_tax_copies(spark, ws):
    rows = manifest(spark, ws, "MOVE")
    assert {r.doc_id: r.dst for r in rows.collect()} == {
        1: "Review/a/n.pdf",
        2: "Review/a/n (2).pdf",
        3: "Unsure/n.pdf",
    }
    [copy] = filing.tax_copies(rows, "Review").collect()
    assert (copy.doc_id, copy.src, copy.dst) == (3, "Unsure/n.pdf", "Review/Steuererklärung/neue Belege/n.pdf")


def test_no_change_only_reports(spark, ws):
    rows = manifest(spark, ws, "NO_CHANGE")
    assert {r.dst for r in rows.collect()} == {"Review/a/n.pdf", "Unsure/n.pdf"}
    assert filing.tax_copies(rows, "Review").count() == 0


def test_promotion_checks_all_first(spark):
    review = spark.createDataFrame([("/Review/a/x.pdf",), ("/Review/y.pdf",)], "path string")
    plan = filing.promotion_plan(review, "/Review/", "/Archiv/")
    assert {r.dst for r in plan.collect()} == {"/Archiv/a/x.pdf", "/Archiv/y.pdf"}
    free = spark.createDataFrame([("/Archiv/b.pdf",)], "path string")
    assert filing.promote(plan, free).count() == 2
    with pytest.raises(filing.PromotionConflict):
        filing.promote(plan, spark.createDataFrame([("/Archiv/y.pdf",)], "path string"))


def test_empty_dirs(spark):
    dirs = spark.createDataFrame([("/R/a",), ("/R/a/b",), ("/R/c",), ("/R/c/d",), ("/X",)], "path string")
    files = spark.createDataFrame([("/R/c/f.pdf",), ("/R/top.pdf",)], "path string")
    assert [r.dir for r in filing.empty_dirs(dirs, files, "/R").collect()] == ["/R/c/d", "/R/a/b", "/R/a"]


def test_cache_reads_each_content_once(spark, ws, tmp_path):
    path = str(tmp_path / "cache")
    files = spark.createDataFrame([("h1", "A"), ("h1", "A"), ("h2", "B")], "content_hash string, text string")
    seen = []

    def read(new):
        seen.append(new.count())
        return new.select("content_hash", F.lower("text").alias("norm_text"))

    assert text_cache.cache_stats(files, text_cache.load_cache(spark, path)).first().asDict() == {
        "hits": 1, "new_entries": 2, "total": 2,
    }
    cache = text_cache.refresh_cache(ws, files, path, read)
    assert {tuple(r) for r in cache.collect()} == {("h1", "a"), ("h2", "b")}
    assert text_cache.refresh_cache(ws, files, path, read).count() == 2
    assert seen == [2, 0]


def test_pages(spark):
    rows = spark.createDataFrame(
        [(1, 10, "c"), (1, 2, "b"), (1, 1, ""), (2, 1, ""), (3, 1, None)], "doc_id int, page_no int, text string"
    )
    assert {r.doc_id: r.text for r in src.assemble_pages(rows).collect()} == {1: "b\nc", 2: None, 3: None}


def test_scans_and_read_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.pdf": "eins", "b.PDF": "kaputt", "c.txt": "x", "sub/d.pdf": "zwei"}.items():
        (tmp_path / name).write_text(body)

    def reader(content):
        if content == b"kaputt":
            raise ValueError("no pages")
        return [content.decode(), "", "Ende"]

    inbox = src.scan_inbox(spark, str(tmp_path))
    assert inbox.count() == 2
    assert src.scan_corpus(spark, str(tmp_path)).count() == 3
    review = src.scan_review(spark, str(tmp_path))
    assert (review.count(), review.columns) == (4, ["path", "length"])
    rows = src.read_pages(inbox, reader).select(src.page_text("pages").alias("text"), "error")
    assert {tuple(r) for r in rows.collect()} == {("eins\nEnde", None), (None, "ValueError: no pages")}


def test_extractor_runs_where_something_is_missing(spark):
    # A class of this function travels to the workers by value.
    class Loud(Extractor):
        def setup(self):
            self.ready = True

        def reply(self, text):
            assert self.ready and len(text) <= 4000
            return None if text == "leer" else f'{{"date":"","subject":"{len(text)}"}}'

    day = datetime.date(2024, 1, 1)
    rows = [(1, "x" * 5000, None, "s"), (2, "yy", day, ""), (3, "zz", day, "s"), (4, "leer", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, date date, subject string")
    got = {r.doc_id: r.reply for r in extract_missing(docs, Loud).collect()}
    assert got == {1: '{"date":"","subject":"4000"}', 2: '{"date":"","subject":"2"}', 3: None, 4: None}


def test_replies_are_asked_once(spark, ws, tmp_path):
    from belegwerk.operators.metadata import extract_stored

    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting(Extractor):
        folder = str(calls)
        broken = False

        def reply(self, text):
            import uuid

            open(f"{self.folder}/{uuid.uuid4().hex}", "w").write(text)
            if self.broken and text == "bad":
                raise RuntimeError("extractor lost")
            return None if text == "leer" else f'{{"date":"","subject":"{text}"}}'

    class Broken(Counting):
        broken = True

    rows = [(i, f"text {i % 7}", None, None) for i in range(20)] + [(30, "leer", None, ""), (31, "full", datetime.date(2024, 1, 1), "s"), (32, None, None, None), (33, "bad", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, date date, subject string")
    store = str(tmp_path / "store")

    def asked():
        return sorted(p.read_text() for p in calls.iterdir())

    with pytest.raises(Exception, match="extractor lost"):
        extract_stored(ws, docs, Broken, store, batch=1).collect()
    before = len(asked())
    got = {r.doc_id: r.reply for r in extract_stored(ws, docs, Counting, store, batch=3).collect()}
    assert got[5] == '{"date":"","subject":"text 5"}' and got[30] is None and got[31] is None and got[32] is None and got[33]
    # Some replies were stored before the failure; none of the nine prompts was lost or asked again but the bad one.
    assert sorted(set(asked())) == sorted([f"text {i}" for i in range(7)] + ["bad", "leer"])
    after = len(asked())
    assert after >= 9 and after - before < 9 + (before == 0)
    again = extract_stored(ws, docs, Counting, store)
    assert {r.doc_id: r.reply for r in again.collect()} == got and len(asked()) == after
    assert extract_stored(ws, docs.limit(1), Counting, store, version="2").first().reply and len(asked()) == after + 1


def test_settle(spark):
    start = datetime.datetime(2024, 1, 1)
    seconds = [("a", s) for s in (0, 4, 9, 15)] + [("b", 2), ("b", 7.000001)]
    events = spark.createDataFrame(
        [(i, start + datetime.timedelta(seconds=s)) for i, s in seconds], "inbox string, ts timestamp"
    )
    rows = settle.settle(events, 5).orderBy("inbox", "first_event").collect()
    assert [(r.inbox, r.n_events) for r in rows] == [("a", 3), ("a", 1), ("b", 1), ("b", 1)]
    assert rows[0].settled_at == start + datetime.timedelta(seconds=14)


def test_stream_takes_each_file_once_and_replays_a_failed_batch(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    fail = [True]

    def process(batch, batch_id):
        if fail.pop() if fail else False:
            raise RuntimeError("broken batch")
        return batch.select(F.element_at(F.split("path", "/"), -1).alias("name"))

    def run():
        intake.start(src.watch_inbox(spark, str(inbox)), process, out).awaitTermination()

    (inbox / "a.pdf").write_text("1")
    with pytest.raises(Exception, match="broken batch"):
        run()
    run()
    (inbox / "b.PDF").write_text("2")
    (inbox / "c.txt").write_text("3")
    run()
    run()
    rows = intake.sink_rows(spark, out).select("name", "batch_id").collect()
    assert sorted(map(tuple, rows)) == [("a.pdf", 0), ("b.PDF", 1)]
    metrics = intake.metrics(spark, out)
    assert sorted(map(tuple, metrics.collect())) == [(0, 1, 1), (1, 1, 1)]
    assert intake.totals(metrics).first().asDict() == {"n_batches": 2, "n_files": 2, "n_rows": 2}


def test_bad_files_are_set_aside(spark, tmp_path):
    inbox, out, ticks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ticks")
    inbox.mkdir()
    bad = {"b3.pdf", "b7.pdf"}
    start = datetime.datetime(2024, 1, 1)

    def process(batch, batch_id):
        name = F.element_at(F.split("path", "/"), -1)
        return batch.select(F.when(name.isin(*bad) if bad else F.lit(False), F.raise_error(F.lit("broken"))).otherwise(name).alias("name"))

    def run(hours):
        spark.createDataFrame([(start + datetime.timedelta(hours=hours),)], "ts timestamp").write.mode("append").parquet(ticks)
        clock = spark.readStream.schema("ts timestamp").parquet(ticks)
        files = lambda: src.scan_inbox(spark, str(inbox))
        intake.start_forgiving(src.watch_inbox(spark, str(inbox)), clock, files, process, out, attempts=3, pause_seconds=3600).awaitTermination()
        return sorted(r.name for r in intake.sink_rows(spark, out).collect())

    for i in range(9):
        (inbox / f"b{i}.pdf").write_text(str(i))
    good = [f"b{i}.pdf" for i in range(9) if i not in (3, 7)]
    assert run(0) == good
    waiting = intake.ledger(spark, out, 0).where("path is not null").collect()
    assert {(r.path.rsplit("/", 1)[1], r.attempts) for r in waiting} == {("b3.pdf", 1), ("b7.pdf", 1)} and all("broken" in r.error for r in waiting)
    assert {r.next_try for r in waiting} == {start + datetime.timedelta(hours=1)}
    # Too early for another try; then one file is mended, and the other fails to the end.
    assert run(0.5) == good
    bad.remove("b7.pdf")
    assert run(2) == sorted([*good, "b7.pdf"])
    assert run(20) == sorted([*good, "b7.pdf"])
    [lost] = intake.given_up(spark, out).collect()
    assert (lost.path.rsplit("/", 1)[1], lost.attempts) == ("b3.pdf", 3)
    assert intake.ledger(spark, out, 3).where("path is not null").count() == 0
    bad.update(f"c{i}.pdf" for i in range(9))
    for i in range(9):
        (inbox / f"c{i}.pdf").write_text(str(i))
    with pytest.raises(Exception, match="nothing in batch 4"):
        run(30)


def test_train_folder_reads_each_content_once(spark, ws, tmp_path):
    from belegwerk.plans.training import folder_corpus

    calls = tmp_path / "calls"
    calls.mkdir()
    root = tmp_path / "root"
    texts = {"a/x.pdf": "one text to read", "a/copy.pdf": "one text to read", "b/c/y.PDF": "another text here", "top.pdf": "no label at all", "b/bad.pdf": "bad"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    def reader(content, folder=str(calls)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").write(content.decode())
        if content == b"bad":
            raise ValueError("no page")
        return [content.decode()]

    cache = str(tmp_path / "cache")
    for total in (3, 4):
        rows = folder_corpus(ws, f"file://{root}", reader, cache).collect()
        assert sorted((r.label, r.norm) for r in rows) == [("a", "one text to read")] * 2 + [("b/c", "another text here")]
        # The unreadable file is tried again, the others are not.
        assert len(list(calls.iterdir())) == total


def test_scanned_paths_have_labels_and_targets(spark, tmp_path):
    from belegwerk.functions.paths import label_of
    from belegwerk.sources.files import scan_corpus, scan_inbox, scan_review

    for name in ("a/b/x.pdf", "y.pdf", "year=2024/z.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    root = str(tmp_path)
    assert {r[0] for r in scan_corpus(spark, root).select(label_of("path", root)).collect()} == {"a/b", None, "year=2024"}
    assert [r.path.rsplit("/", 1)[1] for r in scan_inbox(spark, root).collect()] == ["y.pdf"]
    assert scan_inbox(spark, f"{root}/a").count() == 0
    plan = filing.promotion_plan(scan_review(spark, root), root, "/Archiv")
    assert {r.dst for r in plan.collect()} == {"/Archiv/a/b/x.pdf", "/Archiv/y.pdf", "/Archiv/year=2024/z.pdf"}
    dirs = spark.createDataFrame([(f"{root}/a",), (f"file:{root}/a/b",), (f"{root}/none",)], "path string")
    assert [r.dir for r in filing.empty_dirs(dirs, scan_review(spark, root), root).collect()] == [f"{root}/none"]
    with pytest.raises(filing.PromotionConflict):
        filing.promote(filing.promotion_plan(scan_review(spark, root), "/elsewhere", "/Archiv"), plan.selectExpr("dst as path"))


def test_unusable_caches_are_replaced(spark, ws, tmp_path):
    files = spark.createDataFrame([("h1", "A"), ("h2", "B")], "content_hash string, text string")

    def read(rows):
        return rows.selectExpr("content_hash", "lower(text) as norm_text")

    garbage, foreign, double = (str(tmp_path / n) for n in ("garbage", "foreign", "double"))
    (tmp_path / "garbage").mkdir()
    (tmp_path / "garbage" / "part-0.parquet").write_bytes(b"PAR1 no table")
    spark.range(3).write.parquet(foreign)
    twice = spark.createDataFrame([("h1", "a"), ("h1", "a")], "content_hash string, norm_text string")
    twice.write.parquet(double)
    for path in (garbage, foreign, double):
        cache = text_cache.refresh_cache(ws, files, path, read)
        assert sorted(cache.collect()) == [("h1", "a"), ("h2", "b")]
        assert text_cache.with_cached_text(files, cache).count() == 2


def test_cache_loses_nothing(spark, ws, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(f"hash{i:04d}", f"text {i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "content_hash string, norm_text string")
    first = text_cache.TextCache(spark, path)
    # Two jobs that opened the same empty cache, one of them with entries of the other.
    second = text_cache.TextCache(spark, path)
    first.add(ws, frame.where("content_hash < 'hash0400'"))
    cache = second.add(ws, frame.where("content_hash >= 'hash0300'"))
    assert len(cache.parts) == 2 and sorted(map(tuple, cache.entries().collect())) == rows
    asked = spark.createDataFrame([("hash0001",), ("hash0001",), ("hash0350",), ("new",), (None,)], "content_hash string")
    assert sorted(r[0] for r in cache.hits(asked).collect()) == ["hash0001", "hash0001", "hash0350"]
    assert [r[0] for r in cache.misses(asked).collect()] == ["new"]
    assert sorted((r.content_hash or "", r.norm_text) for r in cache.with_text(ws, asked).collect()) == [("", None), ("hash0001", "text 1"), ("hash0001", "text 1"), ("hash0350", "text 350"), ("new", None)]
    merged = cache.merge_parts(ws)
    assert len(merged.parts) == 1 and merged.entries().count() == 600
    # One broken file of many: its entries are read anew, all others stay, and nothing is merged meanwhile.
    more = merged.add(ws, spark.createDataFrame([("late", "text")], "content_hash string, norm_text string"))
    broken = next((tmp_path / "cache" / "parts" / merged.parts[0].name / "entries").rglob("part-*.parquet"))
    kept = broken.read_bytes()
    broken.write_bytes(b"PAR1 no table")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    files = frame.unionByName(spark.createDataFrame([("late", "")], "content_hash string, norm_text string"))
    again = []

    def read(new):
        again.append(new.count())
        return new.limit(0)

    cache = text_cache.refresh(ws, files, path, read)
    assert again == [600] and len(cache.merge_parts(ws).parts) == 2
    broken.write_bytes(kept)
    assert text_cache.TextCache(spark, path).entries().count() == 601 and len(more.parts) == 2


def test_cache_buckets_and_filters(spark, ws, tmp_path, monkeypatch):
    monkeypatch.setattr(text_cache, "BUCKET_ROWS", 50)
    monkeypatch.setattr(text_cache, "MOST_PARTS", 2)
    frame = spark.range(900).selectExpr("md5(cast(id as string)) as content_hash", "cast(id as string) as norm_text")
    cache = text_cache.TextCache(spark, str(tmp_path / "cache"))
    for i in range(3):
        cache = cache.add(ws, frame.where(f"norm_text % 3 = {i}"))
    # The third part was one too many.
    assert [p.rows for p in cache.parts] == [900] and cache.parts[0].buckets == 18
    other = spark.range(900, 2900).selectExpr("md5(cast(id as string)) as content_hash")
    assert cache._may_hold(cache.parts[0], frame.select("content_hash")).count() == 900
    assert cache._may_hold(cache.parts[0], other).count() < 120
    assert cache.misses(other).count() == 2000 and cache.known(other).count() == 0
    some = frame.where("norm_text in ('5', '77')").select("content_hash")
    assert sorted(r.norm_text for r in cache.with_text(ws, some).collect()) == ["5", "77"]


def test_replies_must_be_one_object(spark):
    from belegwerk.functions.replies import parse_reply

    good = '{"date":"2024.1.1","subject":""}'
    rows = [good, f" {good} ", f"{good} danke", good + '{"a":1}', good.replace('"', "'"), f"[{good}]", good + ',"end":1', "", None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    assert [r.i for r in frame.where(parse_reply("r").isNotNull()).orderBy("i").collect()] == [0, 1]


def test_refusals_are_data(spark, ws):
    from belegwerk.plans.evaluate import evaluate
    from belegwerk.plans.training import try_fit

    apart = spark.createDataFrame([(i, "ab"[i % 2], f"word{i} only{i}") for i in range(20)], "doc_id long, label string, norm string")
    assert [r.kind for r in evaluate(ws, ws.stage(apart, "apart")).collect()] == ["refused"]
    model, row = try_fit(ws, apart)
    assert model is None and row.first().reason and row.first().n_docs == 20
    model, row = try_fit(ws, apart.limit(0))
    assert model is None and row.first().reason == "no training data"


def test_workspace_removes_its_tables(spark):
    from belegwerk.workspace import Workspace

    with Workspace(spark) as run:
        assert run.stage(spark.range(3), "some").count() == 3
        folder = Path(run.root.removeprefix("file:"))
        assert folder.exists()
    assert not folder.exists()


def test_a_folder_is_listed_as_one_path(spark, tmp_path):
    """No listing job with a task per file, and files of subfolders are not read."""
    (tmp_path / "in box" / "below").mkdir(parents=True)
    for i in range(40):
        (tmp_path / "in box" / f"{i} ä.PDF").write_bytes(b"x")
        (tmp_path / "in box" / "below" / f"{i}.pdf").write_bytes(b"y" * 1000)
    (tmp_path / "in box" / "note.txt").write_bytes(b"z")
    spark.sparkContext.setJobGroup("listing", "")
    files = src.scan_inbox(spark, f"{tmp_path}/in box/")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    spark.sparkContext.setJobGroup("reading", "")
    assert {bytes(r.content) for r in files.collect()} == {b"x"} and files.count() == 40
    assert files.columns == ["path", "modificationTime", "length", "content"]
    plan = files._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    scan.executeColumnar if scan.supportsColumnar() else scan.execute().count()
    assert scan.metrics().apply("numFiles").value() == 40
    assert src.scan_inbox(spark, f"file:{tmp_path}/in box").count() == 40
    assert src.scan_inbox(spark, f"{tmp_path}/none").count() == 0


def test_document_folder_is_written_by_all_tasks(spark, tmp_path):
    """One folder that holds all files is no single task's work."""
    from belegwerk.plans.derived import Tables

    rows = [(i, f"text {i}", "de", "src1") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    root = Tables(spark, str(tmp_path)).document_folder()
    names = [r.path for r in src.scan_corpus(spark, root).select("path").collect()]
    assert len(names) == 8 and all("/lang=de/source=src1/" in n for n in names)
    assert len({n.rsplit("/", 1)[1].split("-")[1] for n in names}) > 1
