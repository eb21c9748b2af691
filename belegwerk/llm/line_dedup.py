"""Lines that most pages of a site carry, found by their frequency relative to the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.common import BLANKS, fresh, null_safe, spread_rows
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace

RATIO = 0.1
MIN_PAGES = 5


def _mark(line: Column) -> Column:
    """128 bits that stand for a line without the blanks at its ends."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _sized(line: Column) -> Column:
    """A line's mark and its characters."""
    mark = _mark(line)
    return F.struct(mark["a"].alias("a"), mark["b"].alias("b"), F.length(F.btrim(line, F.lit(BLANKS))).alias("size"))


def boilerplate(
    ws: Workspace,
    docs: DataFrame,
    text: str,
    host: str,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    merge_copies: bool = False,
) -> DataFrame:
    """``host_key, marks``: the marks of each host's boilerplate lines.

    A page is a row, or with ``merge_copies`` all rows of a host with one text, null and empty being
    one too. A line counts once a page. It is boilerplate if at least ``min_pages`` pages carry it and they are more than ``ratio`` of the
    host's pages. A host has fewer such lines than the mean number of lines of its pages divided by
    ``ratio``, so the list is short however many pages there are.

    Near copies of an article share its lines as a site shares its menu, but there these lines are most of the
    page. So with ``merge_copies`` a page counts for its frequent lines only if they make up half of its text or
    less, in characters of its different lines; the lines that are still frequent then are the boilerplate.
    """
    # 128 bits stand for a text and for a line; only these are shuffled, and copies collapse before that.
    same = [F.xxhash64("text").alias("p"), F.xxhash64(F.lit(7), "text").alias("q")] if merge_copies else []
    pages = spread_rows(docs.select(null_safe(host).alias("host_key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    pages = pages.select("host_key", *same, F.array_distinct(F.transform(F.split("text", "\n"), _sized)).alias("lines"))
    page = ["host_key", "p", "q"] if merge_copies else ["host_key"]
    each = pages.select(*page).distinct() if merge_copies else pages
    totals = ws.stage(each.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_pages")), "totals")

    def common(lines: DataFrame) -> DataFrame:
        lines = lines.select(*page, "a", "b").distinct() if merge_copies else lines
        counts = lines.groupBy("host_key", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
        often = counts.join(totals, "host_key").where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
        blank = _mark(F.lit(""))
        often = often.where((F.col("a") != blank["a"]) | (F.col("b") != blank["b"]))
        lists = often.groupBy("host_key").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
        return ws.stage(lists, "boilerplate")

    lists = common(pages.select(*page, F.inline("lines")))
    if not merge_copies:
        return lists
    found = lookup_join(pages, lists, "host_key")
    mine = F.filter("lines", lambda x: F.array_contains("marks", F.struct(x.a.alias("a"), x.b.alias("b"))))
    found = found.withColumn("mine", mine).where(F.size("mine") > 0)
    size = lambda name: F.aggregate(name, F.lit(0), lambda acc, x: acc + x.size)
    return common(found.where(size("mine") * 2 <= size("lines")).select(*page, F.inline("mine")))


def drop_boilerplate(
    ws: Workspace,
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    merge_copies: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines end at a line feed and are compared without the blanks at their ends; blank lines stay.
    Kept lines stay as they are. A null host is a host of its own. A null text stays null and an
    empty one empty, with no line counted; a text of boilerplate only becomes empty. Repeated rows are
    pages of their own, or one page with ``merge_copies``: then a document does not become boilerplate by
    its copies, nor by near copies; each row is still cleaned. Columns named as the new ones are replaced.
    """
    lists = boilerplate(ws, docs, text, host, ratio, min_pages, merge_copies)
    by, marks, split, kept = fresh(docs, "_host", "_marks", "_lines", "_kept")
    lists = lists.withColumnsRenamed({"host_key": by, "marks": marks})
    joined = lookup_join(docs.withColumn(by, null_safe(host)), lists, by, "left")
    lines = F.split(F.col(text), "\n")
    clean = F.filter(lines, lambda line: ~F.array_contains(F.col(marks), _mark(line)))
    out = joined.withColumn(split, lines).withColumn(kept, F.when(F.col(marks).isNull(), lines).otherwise(clean))
    empty = F.coalesce(F.length(text) == 0, F.lit(True))
    n_lines = F.when(empty, 0).otherwise(F.size(split))
    n_dropped = F.when(empty, 0).otherwise(F.size(split) - F.size(kept))
    return (
        out.withColumn("n_lines", n_lines.cast("long"))
        .withColumn("n_dropped", n_dropped.cast("long"))
        .withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))
        .drop(by, marks, split, kept)
    )


SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS row_no, doc_id, source, text FROM documents),
texts AS (SELECT row_number() OVER () AS page_no, source, text FROM (SELECT DISTINCT source, coalesce(text, '') AS text FROM documents)),
marks AS (
  SELECT DISTINCT page_no, source, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS mark
  FROM (SELECT page_no, source, unnest(string_split(text, chr(10))) AS line FROM texts)),
totals AS (SELECT source, count(*) AS n_pages FROM texts GROUP BY source),
frequent AS (
  SELECT m.source, m.mark FROM (SELECT source, mark, count(*) AS n FROM marks GROUP BY source, mark) m
  JOIN totals t ON m.source IS NOT DISTINCT FROM t.source
  WHERE m.n >= {MIN_PAGES} AND m.n > {RATIO} * t.n_pages AND m.mark <> ''),
shares AS (
  SELECT m.page_no, sum(length(m.mark)) AS size, coalesce(sum(length(m.mark)) FILTER (f.mark IS NOT NULL), 0) AS mine
  FROM marks m LEFT JOIN frequent f ON m.source IS NOT DISTINCT FROM f.source AND m.mark = f.mark GROUP BY m.page_no),
common AS (
  SELECT c.source, c.mark FROM (
    SELECT m.source, m.mark, count(*) AS n
    FROM marks m JOIN frequent f ON m.source IS NOT DISTINCT FROM f.source AND m.mark = f.mark
    JOIN shares s ON m.page_no = s.page_no AND s.mine * 2 <= s.size GROUP BY m.source, m.mark) c
  JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.n_pages),
lines AS (
  SELECT row_no, source, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS mark
  FROM (SELECT row_no, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
        FROM pages WHERE text <> '')),
kept AS (
  SELECT l.row_no, count(*) AS n_lines, count(*) FILTER (c.mark IS NOT NULL) AS n_dropped,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.mark IS NULL) AS text
  FROM lines l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.mark = c.mark GROUP BY l.row_no)
SELECT p.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN k.n_dropped > 0 THEN coalesce(k.text, '') ELSE p.text END AS text
FROM pages p LEFT JOIN kept k ON p.row_no = k.row_no
"""
