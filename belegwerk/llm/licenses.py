"""License notices and texts inside documents, by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from belegwerk.llm.common import spread_rows
from belegwerk.llm.license_texts import FULL_TEXTS, NOTICES
from belegwerk.workspace import Workspace

DICE = 0.8
TEMPLATES = NOTICES + FULL_TEXTS
# Pairs of words of a document that one row holds; windows run on into what follows.
CHUNK = 2048


def word_list(text: Column) -> Column:
    """Runs of A-Z, a-z and 0-9; whatever else stands between them is left out."""
    return F.array_remove(F.split(text, "[^a-zA-Z0-9]+"), "")


def _pairs(words: Column) -> Column:
    """Pairs of neighbouring words, in order and in lower case."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.lower(F.concat(a, F.lit(" "), b)))
    return F.slice(pairs, F.lit(1), F.size(words) - 1)


def _once(value: Column) -> Column:
    """``value`` as a generated column: plain ones would be worked out anew wherever they are used."""
    return F.explode(F.array(value))


def template_table(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``template, license, grams, length`` of the templates, made without Python workers; ``length`` counts pairs."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("wording")) for i, (n, t) in enumerate(templates)])
    named = docs.sparkSession.range(1).select(F.inline(rows))
    named = named.withColumn("words", word_list(F.col("wording"))).where("size(words) > 1")
    return named.select(
        "template", "license", F.array_distinct(_pairs(F.col("words"))).alias("grams"), (F.size("words") - 1).alias("length")
    )


def bounds(size: int, dice: float) -> tuple[int, int]:
    """The smallest and largest size of a set that can reach ``dice`` with one of ``size``.

    With sizes a and b the coefficient is at most ``2 min(a, b) / (a + b)``. The smallest size is also the least
    number of common members. The margin is for products like 6 * 0.8 / 1.2 that come out above 4.
    """
    return math.ceil(size * dice / (2 - dice) - 1e-9), math.floor(size * (2 - dice) / dice + 1e-9)


def _offer(listed: list[Row], dice: float) -> Column:
    """The templates as one constant array; their number and wordings are fixed, so its size is."""
    return F.array(
        *[
            F.struct(
                F.lit(t["license"]).alias("license"),
                F.split(F.lit("|".join(t["grams"])), "[|]").alias("grams"),
                F.lit(t["length"]).alias("own"),
                F.lit(bounds(len(t["grams"]), dice)[0]).alias("least"),
                F.lit(bounds(len(t["grams"]), dice)[1]).alias("most"),
            )
            for t in listed
        ]
    )


def _best_window() -> Column:
    """The best ``score`` and the ``minus`` of its place in a chunk's ``pairs``, from ``at``, the places of the template's pairs."""

    def score(place: Column, turn: Column, length: str) -> Column:
        inside = F.filter(F.slice("at", turn + 1, F.col(length)), lambda q: q < place + F.col(length))
        window = F.slice("pairs", place, F.element_at(inside, -1) - place + 1)
        common = F.size(F.array_intersect(window, F.col("grams")))
        return F.lit(2.0) * common / (F.size(F.array_distinct(window)) + F.size("grams"))

    def at_start(place: Column, turn: Column) -> Column:
        longest = F.greatest("own", "most")
        enough = (place <= CHUNK) & (F.get("at", turn + F.col("least") - 1) - place < longest)
        best = F.greatest(score(place, turn, "own"), score(place, turn, "most"))
        return F.when(enough, F.struct(best.alias("score"), (-place).alias("minus")))

    return F.array_max(F.transform("at", at_start))


def _chunks(docs: DataFrame, key: str, text: str, overlap: int) -> DataFrame:
    """``doc_id, chunk, pairs``: each row's pairs of words, ``CHUNK`` at a time and ``overlap`` more."""
    rows = spread_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    rows = rows.where(F.length("text") > 0).select("doc_id", _once(word_list(F.col("text"))).alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - 2, F.lit(CHUNK))
    cut: Callable[[Column], Column] = lambda s: F.slice("words", s + 1, F.lit(CHUNK + overlap + 1))
    rows = rows.where(F.size("words") > 1).select("doc_id", F.posexplode(F.transform(starts, cut)).alias("chunk", "words"))
    return rows.select("doc_id", "chunk", _once(_pairs(F.col("words"))).alias("pairs"))


def scan(
    ws: Workspace,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    dice: float = DICE,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """``doc_id, license, score, word``: licenses whose notice or text stands somewhere in a document.

    The whole text is normalised, line ends included, so notices may be wrapped or stand inside other text. A
    template is compared with windows of the text: sets of pairs of neighbouring words, by the Dice
    coefficient. A window starts at a pair that the template has, is as long as the template or as the largest
    size that can reach ``dice`` (``bounds``), and ends with the last pair in it that the template has. A license
    has the score of its best window over all its templates, and ``word`` is that window's first word, counted
    from 0; ties go to the earlier one.

    What cannot match is left in steps, each by the bounds: chunks with too few pairs of any template, templates with
    too few pairs in a chunk, starts with too few pairs ahead. Null and empty texts and those of one word have no hits. Rows
    with equal or null keys share their hits. A chunk is bounded, so a very long text is no large value past its split.
    """
    listed = ws.stage(template_table(docs, templates), "templates").collect() if templates else []
    if not listed:
        return docs.select(F.col(key).alias("doc_id")).limit(0).selectExpr("doc_id", "'' license", "0D score", "0L word")
    overlap = max(max(t["length"], bounds(len(t["grams"]), dice)[1]) for t in listed)
    low = min(bounds(len(t["grams"]), dice)[0] for t in listed)
    known = sorted({gram for t in listed for gram in t["grams"]})
    rows = _chunks(docs, key, text, overlap)
    theirs = F.array_distinct(F.filter("pairs", lambda pair: pair.isin(known)))
    rows = rows.select("doc_id", "chunk", "pairs", _once(theirs).alias("theirs")).where(F.size("theirs") >= low)
    fits = F.filter(
        _offer(listed, dice),
        lambda t: (F.size("theirs") >= t["least"]) & (F.size(F.array_intersect(F.col("theirs"), t["grams"])) >= t["least"]),
    )
    rows = rows.select("doc_id", "chunk", "pairs", F.inline(fits))
    places = F.transform("pairs", lambda pair, i: F.when(F.array_contains(F.col("grams"), pair), i + 1))
    rows = rows.withColumn("at", _once(F.filter(places, lambda place: place.isNotNull())))
    rows = rows.select("doc_id", "chunk", "license", _once(_best_window()).alias("best")).where(F.col("best.score") >= dice)
    word = F.col("chunk").cast("long") * CHUNK - F.col("best.minus") - 1
    hits = rows.select("doc_id", "license", (-F.col("best.score")).alias("minus"), word.alias("word"))
    best = hits.groupBy("doc_id", "license").agg(F.min(F.struct("minus", "word")).alias("best"))
    return best.select("doc_id", "license", (-F.col("best.minus")).alias("score"), F.col("best.word").alias("word"))


def licensed(ws: Workspace, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc_id, license, score, n_hits``: its best license, or nulls and zero.

    ``n_hits`` counts the different licenses found. Ties go to the first license by name. Rows with equal or null
    keys share their hits.
    """
    hits = scan(ws, docs, key, text)
    best = hits.groupBy("doc_id").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), F.col("license").alias("license"))).alias("best"),
        F.count(F.lit(1)).alias("n_hits"),
    )
    rows = docs.select(F.col(key).alias("doc_id"))
    found = best.select(F.col("doc_id").alias("_id"), "best", F.col("n_hits").alias("_hits"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.col("best.license").alias("license"),
        (-F.col("best.minus")).alias("score"),
        F.coalesce("_hits", F.lit(0)).cast("long").alias("n_hits"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORM = "lower(trim(regexp_replace({0}, '[^a-zA-Z0-9]+', ' ', 'g')))"
_PAIRS = "[{0}[i] || ' ' || {0}[i + 1] for i in range(1, len({0}))]"

SQL = f"""
WITH wordings(template, license, wording) AS (VALUES
  {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
templates AS (
  SELECT template, license, pairs, list_distinct(pairs) AS grams FROM
    (SELECT template, license, {_PAIRS.format("w")} AS pairs FROM
      (SELECT template, license, string_split({_NORM.format("wording")}, ' ') AS w FROM wordings))),
lengths AS (
  SELECT template, license, len(grams) AS size,
    unnest(list_distinct([len(pairs), floor(len(grams) * (2 - {DICE}) / {DICE} + 1e-9)::BIGINT])) AS length FROM templates),
docs AS (
  SELECT rid, doc_id, {_PAIRS.format("w")} AS pairs FROM
    (SELECT row_number() OVER () AS rid, doc_id, string_split({_NORM.format("text")}, ' ') AS w FROM documents WHERE text <> '')),
members AS (SELECT template, unnest(grams) AS gram FROM templates),
places AS (
  SELECT rid, unnest(pairs) AS gram, generate_subscripts(pairs, 1) AS pos FROM docs),
occurrences AS (SELECT rid, template, gram, pos FROM places JOIN members USING (gram)),
likely AS (
  SELECT rid, template FROM occurrences JOIN templates USING (template)
  GROUP BY rid, template HAVING count(DISTINCT gram) >= any_value(len(grams)) * {DICE} / (2 - {DICE}) - 1e-9),
marks AS (SELECT o.* FROM occurrences o JOIN likely USING (rid, template)),
windows AS (
  SELECT s.rid, s.template, l.license, l.size, s.pos AS first, max(e.pos) AS last, count(DISTINCT e.gram) AS common
  FROM marks s JOIN lengths l USING (template)
  JOIN marks e ON e.rid = s.rid AND e.template = s.template AND e.pos BETWEEN s.pos AND s.pos + l.length - 1
  GROUP BY s.rid, s.template, l.license, l.size, s.pos, l.length),
scores AS (
  SELECT doc_id, license, 2.0::DOUBLE * common / (len(list_distinct(pairs[first:last])) + size) AS score
  FROM windows JOIN docs USING (rid)
  WHERE common >= size * {DICE} / (2 - {DICE}) - 1e-9),
hits AS (SELECT doc_id, license, max(score) AS score FROM scores WHERE score >= {DICE} GROUP BY doc_id, license),
best AS (
  SELECT doc_id, min({{'minus': -score, 'license': license}}) AS best, count(*) AS n_hits FROM hits GROUP BY doc_id)
SELECT d.doc_id, b.best.license AS license, -b.best.minus AS score, coalesce(b.n_hits, 0) AS n_hits
FROM documents d LEFT JOIN best b ON d.doc_id IS NOT DISTINCT FROM b.doc_id
"""
