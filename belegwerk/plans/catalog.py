"""One query per operator, each over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.functions import dates, fuzzy, paths, replies, text as txt
from belegwerk.operators import bayes, evaluation, features, filing, metadata, naming, ranking, rules, text_cache
from belegwerk.operators.bayes import Model
from belegwerk.plans import evaluate as evaluate_plan
from belegwerk.plans import ingest as ingest_plan
from belegwerk.plans import training
from belegwerk.plans.derived import AS_OF, Tables, decode_page, decode_text, page_of_file
from belegwerk.settings import JobSettings, Rule
from belegwerk.sources import files as src
from belegwerk.sources.model_store import load_model, save_model
from belegwerk.streaming import intake, settle
from belegwerk.workspace import empty

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SETTLE_SECONDS = 3600
DAY = "yyyy-MM-dd"
MOMENT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def query(run: Callable[[Tables], DataFrame]) -> Query:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(Tables(spark, sf_dir))

    QUERIES[run.__name__] = call
    return call


def _day(column):
    return F.date_format(column, DAY)


# --- text and terms ---


@query
def normalize(t: Tables) -> DataFrame:
    return t.norms


@query
def tokens(t: Tables) -> DataFrame:
    return t.norms.select("doc_id", F.posexplode(txt.term_words("norm")).alias("pos", "token"))


@query
def stopwords(t: Tables) -> DataFrame:
    kept = txt.without_stop_words(txt.term_words("norm"))
    return t.norms.select("doc_id", F.array_join(kept, " ").alias("kept"))


@query
def bigrams(t: Tables) -> DataFrame:
    kept = t.norms.select("doc_id", txt.without_stop_words(txt.term_words("norm")).alias("kept"))
    return kept.select("doc_id", F.posexplode(txt.word_pairs("kept")).alias("pos", "pair"))


@query
def term_freq(t: Tables) -> DataFrame:
    return features.term_freq(t.corpus).where("term is not null")


def _freqs(t: Tables) -> tuple[DataFrame, DataFrame, int]:
    corpus = t.corpus
    n_docs = corpus.count()
    tf = t.ws.stage(features.term_freq(corpus), "tf")
    return tf, t.ws.stage(features.doc_freq(tf, n_docs), "df", slices=features.row_slices(tf.count())), n_docs


@query
def doc_freq(t: Tables) -> DataFrame:
    return _freqs(t)[1]


@query
def vocab(t: Tables) -> DataFrame:
    _, freqs, n_docs = _freqs(t)
    top = features.top_vocabulary(t.ws, freqs, n_docs)
    return top.select("term", "df", "cf", F.round("idf", 9).alias("idf"))


@query
def tfidf(t: Tables) -> DataFrame:
    tf, freqs, n_docs = _freqs(t)
    rows = features.tfidf_rows(tf, features.top_vocabulary(t.ws, freqs, n_docs))
    return rows.select("doc_id", "term", F.round("tfidf", 9).alias("tfidf"))


# --- classifier ---


def _model(t: Tables) -> Model:
    return bayes.fit(t.ws, t.corpus)


@query
def class_priors(t: Tables) -> DataFrame:
    corpus = t.corpus.select("doc_id", "label")
    priors = bayes.class_priors(bayes.label_table(t.ws, corpus), corpus.count())
    return priors.select("label", "n_docs", F.round("log_prior", 9).alias("log_prior"))


@query
def nb_weights(t: Tables) -> DataFrame:
    m = _model(t)
    named = m.weights.join(m.classes.select("label_id", "label"), "label_id").join(
        m.vocab.select("term_id", "term"), "term_id"
    )
    return named.select("label", "term", F.round("log_prob", 6).alias("log_prob"))


@query
def label_count(t: Tables) -> DataFrame:
    return t.corpus.agg(F.countDistinct("label").alias("n_labels"))


@query
def classify(t: Tables) -> DataFrame:
    docs = t.spread("documents", "doc_id").select("doc_id", "text", txt.normalize_text("text").alias("norm"))
    rows = bayes.classify(_model(t), docs)
    return rows.select("doc_id", "subfolder", F.round("confidence", 6).alias("confidence"))


@query
def top3(t: Tables) -> DataFrame:
    rows = bayes.top_classes(_model(t), t.norms)
    return rows.select("doc_id", "rank", "label", F.round("p", 6).alias("p"))


@query
def top_terms(t: Tables) -> DataFrame:
    rows = bayes.top_terms(_model(t))
    return rows.select("label", "rank", "term", F.round("log_prob", 6).alias("log_prob"))


@query
def model_summary(t: Tables) -> DataFrame:
    return bayes.model_summary(_model(t))


def _model_table(m: Model) -> DataFrame:
    per_class = m.weights.groupBy("label_id").agg(
        F.count(F.lit(1)).alias("n_weights"), F.round(F.sum("log_prob"), 4).alias("sum_log_prob")
    )
    return m.classes.join(per_class, "label_id", "left").select(
        "label",
        "n_docs",
        F.round("log_prior", 9).alias("log_prior"),
        F.round("log_unseen", 9).alias("log_unseen"),
        F.coalesce("n_weights", F.lit(0)).alias("n_weights"),
        F.coalesce("sum_log_prob", F.lit(0.0)).alias("sum_log_prob"),
    )


@query
def model_roundtrip(t: Tables) -> DataFrame:
    path = t.ws.path("model")
    save_model(_model(t), path)
    return _model_table(load_model(t.spark, path))


# --- evaluation ---


@query
def class_filter(t: Tables) -> DataFrame:
    return evaluation.drop_small_classes(
        t.ws, t.fine_labels, evaluation.label_sizes(t.ws, t.fine_labels)
    )


@query
def data_guard(t: Tables) -> DataFrame:
    return evaluation.data_guard(evaluation.label_sizes(t.ws, t.fine_labels))


@query
def excluded_classes(t: Tables) -> DataFrame:
    return evaluation.excluded_classes(evaluation.label_sizes(t.ws, t.fine_labels))


@query
def split(t: Tables) -> DataFrame:
    corpus = t.corpus.select("doc_id", "label")
    sizes = evaluation.label_sizes(t.ws, corpus).where("n_docs >= 2")
    kept = evaluation.drop_small_classes(t.ws, corpus, sizes)
    rows = evaluation.split(t.ws, kept, sizes)
    return rows.select("doc_id", "label", F.col("is_test").cast("int").alias("is_test"))


def _report(report: DataFrame) -> DataFrame:
    metrics = [F.round(m, 6).alias(m) for m in ("precision", "recall", "f1_score")]
    return report.select("label", "kind", *metrics, "support")


@query
def class_report(t: Tables) -> DataFrame:
    pairs = t.read("labels").select(
        F.concat(F.lit("k"), F.col("quality")).alias("truth"),
        F.concat(F.lit("k"), F.col("toxic") * 2).alias("predicted"),
    )
    return _report(evaluation.class_report(t.ws, pairs))


# --- dates, names, replies ---


@query
def text_date(t: Tables) -> DataFrame:
    return t.doc_dates.select("o_orderkey", _day(dates.text_date("text", AS_OF)).alias("day"))


@query
def month_exact(t: Tables) -> DataFrame:
    rows = t.doc_months.select("o_orderkey", dates.month_exact("text", AS_OF).alias("found"))
    return rows.select("o_orderkey", "found.month", "found.year")


@query
def sanitize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", txt.sanitize("text").alias("subject"))


@query
def build_name(t: Tables) -> DataFrame:
    subject = F.expr("concat(o_orderpriority, ': <', o_orderstatus, '>  Nr. ', o_orderkey, '?')")
    return t.read("orders").select("o_orderkey", txt.build_name("o_orderdate", subject).alias("name"))


@query
def first_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", txt.first_line_subject("text").alias("subject"))


KEYWORDS = (("Que", "Frage"), ("und", "Verbindung"), ("the", "Artikel"))


@query
def keyword_subject(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", txt.keyword_subject("text", KEYWORDS).alias("subject"))


@query
def reply_parse(t: Tables) -> DataFrame:
    rows = t.replies.select("o_orderkey", replies.parse_reply("reply").alias("r"))
    return rows.select(
        "o_orderkey",
        F.col("r.date").alias("reply_date"),
        F.col("r.subject").alias("reply_subject"),
        F.col("r").isNotNull().cast("int").alias("complete"),
    )


@query
def reply_date(t: Tables) -> DataFrame:
    rows = t.replies.select("o_orderkey", replies.parse_reply("reply").alias("r"))
    return rows.select("o_orderkey", _day(dates.reply_date("r.date")).alias("day"))


@query
def prompt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", txt.prompt_text("text").alias("prompt"))


@query
def fill_date(t: Tables) -> DataFrame:
    rows = t.doc_dates.join(t.replies.select("o_orderkey", "reply"), "o_orderkey").select(
        "o_orderkey",
        "text",
        replies.parse_reply("reply").alias("r"),
        F.expr("o_orderdate + interval 20 days").alias("mtime"),
        F.expr("case when o_orderkey % 4 = 1 then date '2020-02-29' end").alias("date"),
    )
    filled = metadata.fill_date(rows, AS_OF, F.col("r"))
    return filled.select("o_orderkey", _day("date").alias("day"))


@query
def fill_subject(t: Tables) -> DataFrame:
    rows = t.inbox_docs.select(
        "doc_id",
        "text",
        replies.parse_reply("reply").alias("r"),
        F.expr("case when doc_id % 6 = 0 then 'Aus Regel' when doc_id % 6 = 1 then '' end").alias("subject"),
        F.expr("(doc_id % 100) / 100.0D").alias("confidence"),
    )
    return metadata.fill_subject(rows, F.col("r")).select("doc_id", "subject", "confidence")


# --- fuzzy ---

NEEDLE = "Theren ouqueaux und"


@query
def fuzzy_match(t: Tables) -> DataFrame:
    rows = t.read("part").withColumn("text", F.concat_ws(", ", "p_name", "p_type"))
    hit = fuzzy.fuzzy_match("text", "small ring economy", 0.6)
    return rows.select("p_partkey", hit.cast("int").alias("hit"))


@query
def fuzzy_contains(t: Tables) -> DataFrame:
    hit = fuzzy.fuzzy_contains("text", NEEDLE, 0.6)
    return t.spread("documents", "doc_id").select("doc_id", hit.cast("int").alias("hit"))


@query
def fuzzy_match_docs(t: Tables) -> DataFrame:
    hit = fuzzy.fuzzy_match("text", NEEDLE, 0.5)
    return t.spread("documents", "doc_id").select("doc_id", hit.cast("int").alias("hit"))


LONG_NEEDLE = "red small ring and large economy bolt of the year"


@query
def fuzzy_short(t: Tables) -> DataFrame:
    """Texts shorter than the phrase, which are looked for in the phrase."""
    return t.read("part").select("p_partkey", fuzzy.fuzzy_contains("p_name", LONG_NEEDLE, 0.7).cast("int").alias("hit"))


@query
def fuzzy_find(t: Tables) -> DataFrame:
    span = t.spread("documents", "doc_id").select("doc_id", fuzzy.fuzzy_find("text", NEEDLE, 0.6).alias("s"))
    return span.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query
def month_fuzzy(t: Tables) -> DataFrame:
    rows = t.doc_months.select("o_orderkey", fuzzy.month_fuzzy("text", AS_OF, 0.85).alias("found"))
    return rows.select("o_orderkey", "found.month", "found.year")


@query
def month_year(t: Tables) -> DataFrame:
    rows = rules.month_year(t.doc_months.select("o_orderkey", "text"), AS_OF)
    return rows.select("o_orderkey", "found.month", "found.year")


@query
def apply_rules(t: Tables) -> DataFrame:
    rows = rules.apply_rules(t.rule_docs, JobSettings().rules, AS_OF, "subject")
    return rows.select("o_orderkey", "subject")


QUERIES["rules"] = QUERIES.pop("apply_rules")


class CharacterCount(metadata.Extractor):
    """Smallest useful extractor: counts what it has seen."""

    def reply(self, text: str) -> str:
        return json.dumps({"date": "2024.5.1", "subject": f"{len(text)} Zeichen"})


@query
def plugin_extractor(t: Tables) -> DataFrame:
    rows = t.inbox_docs.select(
        "doc_id",
        "text",
        F.expr("case when doc_id % 3 <> 0 then date '2024-01-01' end").alias("date"),
        F.expr("case when doc_id % 2 = 0 then 'Bekannt' end").alias("subject"),
    )
    asked = metadata.extract_missing(rows, CharacterCount)
    parsed = asked.select("doc_id", replies.parse_reply("reply").alias("r"))
    return parsed.select("doc_id", F.col("r.date").alias("reply_date"), F.col("r.subject").alias("reply_subject"))


# --- paths, routing, manifests ---


@query
def label_from_path(t: Tables) -> DataFrame:
    rows = t.doc_paths.select("doc_id", paths.label_of("path", "/root").alias("label"))
    return rows.where("label is not null")


@query
def path_parts(t: Tables) -> DataFrame:
    path = F.concat(F.substring_index("url", "?", 1), F.expr("case when page_id % 3 = 0 then '.v2.PDF' else '' end"))
    rows = t.read("pages").select("page_id", path.alias("path"))
    name = paths.file_name("path")
    return rows.select(
        "page_id",
        paths.parent("path").alias("parent"),
        name.alias("name"),
        paths.stem(name).alias("stem"),
        paths.suffix(name).alias("suffix"),
        paths.relative_to("path", "http:/").alias("relative"),
    )


@query
def suffix_filter(t: Tables) -> DataFrame:
    return t.inbox_docs.where(paths.is_pdf("path")).select("doc_id", "path")


@query
def min_text(t: Tables) -> DataFrame:
    return t.norms.where(txt.long_enough("norm")).select("doc_id", F.length("norm").alias("n"))


def _scored(t: Tables) -> DataFrame:
    """Documents with a made-up confidence and a name that many share."""
    return t.inbox_docs.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select(
        "doc_id",
        "path",
        F.expr("(doc_id % 40) / 40.0D").alias("confidence"),
        F.expr("case when doc_id % 8 = 0 then '' else concat(lang, '/', source) end").alias("subfolder"),
        F.expr("concat('2024.01.01 ', lang, '.pdf')").alias("name"),
    ).withColumn("bucket", filing.route("confidence"))


@query
def route(t: Tables) -> DataFrame:
    return _scored(t).select("doc_id", "bucket")


@query
def target_path(t: Tables) -> DataFrame:
    target = paths.join_path("bucket", "subfolder", "name")
    return _scored(t).select("doc_id", target.alias("target"))


def _part_names(t: Tables) -> DataFrame:
    return t.read("part").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit("Review/"), F.col("p_brand")).alias("folder"),
        "p_name",
        F.concat("p_name", F.lit(".pdf")).alias("name"),
    )


def _existing_names(t: Tables) -> DataFrame:
    number = F.expr("case when doc_id % 40 = 3 then '' else concat(' (', doc_id % 40, ')') end")
    taken = _part_names(t).where("doc_id % 10 = 3")
    return taken.select("folder", F.concat("p_name", number, F.lit(".pdf")).alias("name"))


@query
def collisions(t: Tables) -> DataFrame:
    rows = naming.resolve_names(t.ws, _part_names(t).drop("p_name"), _existing_names(t))
    return rows.select("doc_id", "folder", "final_name")


@query
def collisions_mixed(t: Tables) -> DataFrame:
    """Like ``collisions``, with wanted names that end in a number themselves."""
    numbered = F.expr("case when doc_id % 7 = 0 then concat(p_name, ' (', doc_id % 5 + 1, ').pdf') else name end")
    wanted = _part_names(t).withColumn("name", numbered).drop("p_name")
    rows = naming.resolve_names(t.ws, wanted, _existing_names(t))
    return rows.select("doc_id", "folder", "final_name")


def _manifest(t: Tables, mode: str = "MOVE") -> DataFrame:
    rows = _scored(t).withColumn("root", F.col("bucket"))
    nothing = empty(t.spark, "folder string, name string")
    return t.ws.stage(filing.manifest(t.ws, rows, nothing, mode), "manifest")


@query
def manifest(t: Tables) -> DataFrame:
    path = t.ws.path("written")
    filing.write_manifest(_manifest(t, "COPY"), path)
    return t.spark.read.parquet(path)


@query
def manifest_view(t: Tables) -> DataFrame:
    return filing.manifest_view(_manifest(t, "NO_CHANGE"), "Review")


@query
def tax_copies(t: Tables) -> DataFrame:
    return filing.tax_copies(_manifest(t), "Review")


def _review_files(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/Review/"), F.expr("replace(split_part(url, '//', 2), '?', '/')"), F.expr("concat('/', page_id, '.pdf')"))
    return t.read("pages").select("page_id", path.alias("path"))


@query
def promote(t: Tables) -> DataFrame:
    plan = filing.promotion_plan(_review_files(t), "/Review", "/Archiv")
    elsewhere = _review_files(t).select("path")
    return filing.promote(plan, elsewhere)


@query
def promote_conflicts(t: Tables) -> DataFrame:
    plan = filing.promotion_plan(_review_files(t), "/Review", "/Archiv")
    there = plan.where("length(dst) % 7 = 0").select(F.col("dst").alias("path"))
    return filing.promotion_conflicts(plan, there).select("src", "dst")


@query
def empty_dirs(t: Tables) -> DataFrame:
    rows = t.documents.select(
        F.expr("concat('/Review/', lang, '/', source, '/', doc_id % 40)").alias("dir"), "doc_id"
    )
    deep = F.array("dir", paths.parent("dir"), paths.parent(paths.parent("dir")))
    dirs = rows.select(F.explode(deep).alias("path")).distinct()
    left = rows.where("doc_id % 11 = 0").select(F.expr("concat(dir, '/', doc_id, '.pdf')").alias("path"))
    return filing.empty_dirs(dirs, left, "/Review")


@query
def folder_counts(t: Tables) -> DataFrame:
    return filing.folder_counts(
        t.documents.select(F.expr("case when doc_id % 10 < 6 then 'Inbox' else 'Review' end").alias("bucket"))
    )


@query
def move_summary(t: Tables) -> DataFrame:
    return filing.move_summary(
        t.documents.select(F.expr("case when doc_id % 9 = 4 then 'failed' else 'moved' end").alias("status"))
    )


@query
def progress(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id")
    rows = ranking.numbered(t.ws, docs, [], ["doc_id"], "i")
    total = t.documents.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return rows.select("doc_id", "i", total.alias("n"))


# --- files and cache ---


@query
def page_assembly(t: Tables) -> DataFrame:
    rows = t.read("conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_no"),
        F.expr("case when (conv_id * 7 + turn) % 6 = 0 then '' else text end").alias("text"),
    )
    return src.assemble_pages(rows)


@query
def scan_inbox(t: Tables) -> DataFrame:
    rows = page_of_file(src.scan_inbox(t.spark, t.page_folder()))
    return rows.select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query
def scan_corpus(t: Tables) -> DataFrame:
    rows = page_of_file(src.scan_corpus(t.spark, t.page_folder()))
    return rows.select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query
def scan_review(t: Tables) -> DataFrame:
    rows = src.scan_review(t.spark, t.page_folder())
    ext = F.lower(paths.suffix(paths.file_name("path")))
    return rows.groupBy(ext.alias("ext")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")
    )


@query
def read_errors(t: Tables) -> DataFrame:
    root = t.ws.path("mixed")
    broken = F.concat(F.lit("%PDF kaputt "), F.col("page_id").cast("string"))
    line = F.when(F.col("page_id") % 9 == 0, broken).otherwise(F.col("line"))
    t.write_files(t.page_files.withColumn("line", line), root, "pdf")
    rows = src.read_pages(src.scan_inbox(t.spark, root), decode_page)
    return rows.select(
        F.coalesce(F.col("pages")[0].cast("long"), F.lit(-1)).alias("page_id"),
        F.col("error").isNotNull().cast("int").alias("failed"),
        F.coalesce(F.length(src.page_text("pages")), F.lit(-1)).alias("n_chars"),
    )


def _hashed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text_cache.content_hash(F.col("text").cast("binary")).alias("content_hash"), "text")


def _cache(t: Tables) -> text_cache.TextCache:
    """A cache of two parts that holds the contents of every third document."""
    cache = text_cache.TextCache(t.spark, t.ws.path("cache"))
    known = _hashed(t).where("doc_id % 3 = 0").select("content_hash", txt.normalize_text("text").alias("norm_text"), "doc_id")
    for half in (0, 1):
        cache = cache.add(t.ws, known.where(f"doc_id % 2 = {half}"))
    return cache


@query
def content_hash(t: Tables) -> DataFrame:
    return _hashed(t).select("doc_id", "content_hash")


@query
def cache_hits(t: Tables) -> DataFrame:
    return _cache(t).hits(t.ws.stage(_hashed(t).select("doc_id", "content_hash"), "files"))


@query
def cache_misses(t: Tables) -> DataFrame:
    return _cache(t).misses(t.ws.stage(_hashed(t).select("content_hash"), "files"))


@query
def cache_refresh(t: Tables) -> DataFrame:
    files = t.ws.stage(_hashed(t).drop("text"), "files")

    def read(new: DataFrame) -> DataFrame:
        rows = t.documents.select("doc_id", "text").join(new, "doc_id")
        return rows.select("content_hash", txt.normalize_text("text").alias("norm_text"))

    return text_cache.refresh_cache(t.ws, files, _cache(t).path, read)


@query
def cache_stats(t: Tables) -> DataFrame:
    return text_cache.cache_stats(_hashed(t).select("content_hash"), _cache(t).entries())


# --- streams ---


def _sessions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "inbox",
        F.date_format("first_event", MOMENT).alias("first_event"),
        F.date_format("settled_at", MOMENT).alias("settled_at"),
        "n_events",
    )


@query
def settle_batch(t: Tables) -> DataFrame:
    events = t.read("events").select(F.col("user_id").alias("inbox"), "ts")
    return _sessions(settle.settle(events, SETTLE_SECONDS))


@query
def settle_stream(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    events = stream.select(F.col("user_id").alias("inbox"), F.col("ts").cast("timestamp").alias("ts"))
    # A clock that has passed the end of the last session.
    passed = F.col("ts").cast("timestamp") + F.make_interval(secs=F.lit(2 * SETTLE_SECONDS))
    ticks = t.ws.path("clock")
    t.read("events").agg(F.max(passed).alias("ts")).write.parquet(ticks)
    clock = t.spark.readStream.schema("ts timestamp").parquet(ticks)
    out = t.ws.path("sessions")
    run = (
        settle.settle_stream(events, SETTLE_SECONDS, clock=clock)
        .writeStream.format("parquet")
        .option("checkpointLocation", t.ws.path("checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    return _sessions(t.spark.read.parquet(out))


def _page_rows(batch: DataFrame, batch_id: int = 0) -> DataFrame:
    return page_of_file(batch).select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query
def stream_intake(t: Tables) -> DataFrame:
    out = t.ws.path("intake")
    stream = src.watch_inbox(t.spark, t.page_folder())
    intake.start(stream, _page_rows, out).awaitTermination()
    return intake.sink_rows(t.spark, out).select("page_id", "digest")


def _two_waves(t: Tables, process, out: str) -> None:
    """Half of the files, a stop, the other half, a restart from the checkpoint."""
    root = t.ws.path("waves")
    for wave in (0, 1):
        t.write_files(t.page_files.where(f"page_id % 2 = {wave}"), root, "pdf")
        intake.start(src.watch_inbox(t.spark, root), process, out).awaitTermination()


@query
def stream_once(t: Tables) -> DataFrame:
    out = t.ws.path("once")
    _two_waves(t, _page_rows, out)
    return intake.sink_rows(t.spark, out).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_times"), F.max("batch_id").cast("long").alias("batch_id")
    )


@query
def stream_settled(t: Tables) -> DataFrame:
    """Two waves of files while the inbox is busy, then a time at which it has been quiet for long."""
    root, ticks, out = t.ws.path("busy"), t.ws.path("ticks"), t.ws.path("settled")

    def run(seconds: int) -> None:
        newest = F.max(F.col("modificationTime") + F.make_dt_interval(secs=F.lit(seconds)))
        src.scan_inbox(t.spark, root).agg(newest.alias("ts")).write.mode("append").parquet(ticks)
        clock = t.spark.readStream.schema("ts timestamp").parquet(ticks)
        files = lambda: src.scan_inbox(t.spark, root)
        stream = src.watch_inbox(t.spark, root)
        intake.start_settled(stream, clock, files, _page_rows, out, SETTLE_SECONDS).awaitTermination()

    for wave in (0, 1):
        t.write_files(t.page_files.where(f"page_id % 2 = {wave}"), root, "pdf")
        run(SETTLE_SECONDS // 2)
    run(2 * SETTLE_SECONDS)
    return intake.sink_rows(t.spark, out).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_times"), F.max("batch_id").cast("long").alias("batch_id")
    )


@query
def stream_metrics(t: Tables) -> DataFrame:
    out = t.ws.path("metrics")
    _two_waves(t, _page_rows, out)
    return intake.metrics(t.spark, out)


@query
def stream_retry(t: Tables) -> DataFrame:
    out = t.ws.path("retry")
    attempts: list[int] = []

    def unsteady(batch: DataFrame, batch_id: int) -> DataFrame:
        attempts.append(batch_id)
        if len(attempts) == 1:
            # Rows get as far as the sink before the batch fails.
            _page_rows(batch).write.parquet(f"{out}/rows/batch_id={batch_id}")
            raise RuntimeError("lost in the middle of a batch")
        return _page_rows(batch)

    stream = src.watch_inbox(t.spark, t.page_folder())
    try:
        intake.start(stream, unsteady, out).awaitTermination()
    except Exception as error:
        if "lost in the middle of a batch" not in str(error):
            raise
    intake.start(stream, unsteady, out).awaitTermination()
    return intake.sink_rows(t.spark, out).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_times"))


@query
def stream_poison(t: Tables) -> DataFrame:
    """One file that no job gets through: all others are filed with their batch, it is retried and then given up."""
    root, ticks, out = t.page_folder(), t.ws.path("ticks"), t.ws.path("poison")

    def process(batch: DataFrame, batch_id: int) -> DataFrame:
        broken = F.raise_error(F.lit("no page in this file"))
        return _page_rows(batch).withColumn("digest", F.when(F.col("page_id") == 1, broken).otherwise(F.col("digest")))

    for hours in (0, 12, 24):
        now = F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))
        t.spark.range(1).select(now.alias("ts")).write.mode("append").parquet(ticks)
        clock = t.spark.readStream.schema("ts timestamp").parquet(ticks)
        files = lambda: src.scan_inbox(t.spark, root)
        intake.start_forgiving(src.watch_inbox(t.spark, root), clock, files, process, out).awaitTermination()
    # Only the files that were given up are opened.
    lost = page_of_file(src.scan_inbox(t.spark, root).join(intake.given_up(t.spark, out).select("path"), "path", "left_semi"))
    lost = lost.join(intake.given_up(t.spark, out), "path").select("page_id", F.lit(0).cast("long").alias("n_times"), "attempts")
    filed = intake.sink_rows(t.spark, out).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_times"))
    return filed.select("page_id", "n_times", F.lit(0).alias("attempts")).unionByName(lost)


@query
def stream_process(t: Tables) -> DataFrame:
    out = t.ws.path("process")

    def read(batch: DataFrame) -> DataFrame:
        return page_of_file(batch).select(
            F.col("page_id").alias("doc_id"), "path", F.col("html").alias("text"), F.lit(AS_OF).cast("timestamp").alias("mtime")
        )

    job = JobSettings(as_of=AS_OF)
    process = intake.ingest_batches(t.ws, read, _model(t), job, out, CharacterCount)
    _two_waves(t, process, out)
    return intake.sink_rows(t.spark, out).select("doc_id", "dst", "bucket", "subfolder", "action")


# --- whole jobs ---


@query
def train(t: Tables) -> DataFrame:
    return _model_table(training.train(t.ws, t.doc_paths, "/root"))


@query
def train_changes(t: Tables) -> DataFrame:
    """The model of the whole corpus, after a store learned an older state of it: other texts, labels and files."""
    store, now = t.ws.path("terms"), t.doc_paths
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 100
    text = F.when(draw == 2, F.reverse("text")).otherwise(F.col("text"))
    path = F.when(draw == 3, F.replace("path", F.lit("/root/"), F.lit("/root/old/"))).otherwise(F.col("path"))
    older = now.where(draw != 1).withColumn("text", text).withColumn("path", path)
    removed = now.where(draw == 4).withColumn("doc_id", -1 - F.col("doc_id"))
    training.train_changes(t.ws, older.unionByName(removed), "/root", store)
    return _model_table(training.train_changes(t.ws, now, "/root", store))


INGEST_RULES = (
    Rule(1, "en/src1", "keyword", "the", "Englischer Beleg", group="a"),
    Rule(2, "en/src1", "keyword", "and", "Zweiter Beleg", group="a"),
    Rule(3, "de/src2", "keyword", "und", "Deutscher Beleg"),
)


@query
def ingest(t: Tables) -> DataFrame:
    job = JobSettings(as_of=AS_OF, rules=INGEST_RULES, threshold=0.5)
    nothing = empty(t.spark, "folder string, name string")
    rows = ingest_plan.ingest(t.ws, t.inbox_docs, _model(t), nothing, job)
    return rows.select("doc_id", "src", "dst", "bucket", "subfolder", "action")


@query
def evaluate(t: Tables) -> DataFrame:
    return _report(evaluate_plan.evaluate(t.ws, t.corpus))


@query
def train_folder(t: Tables) -> DataFrame:
    return _model_table(training.train_folder(t.ws, t.document_folder(), decode_text))


@query
def ingest_folder(t: Tables) -> DataFrame:
    nothing = empty(t.spark, "folder string, name string")
    rows = ingest_plan.ingest_folder(t.ws, t.page_folder(), decode_text, _model(t), nothing, JobSettings(as_of=AS_OF), CharacterCount)
    return rows.groupBy("bucket", "subfolder", "action").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("dst").alias("n_targets"))
