"""Benchmark passages in documents, by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.common import null_safe, spread_rows, texts_of
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace

MIN_TILE = 5
COVERAGE = 0.8
FIRST_LENGTH = 20
# Characters of benchmark texts that one pass over the documents holds.
BLOCK_CHARS = 8 << 20

_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _TOKEN.findall(text.lower()) if text else []


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``size`` ids, from one running sum."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(len(ids), _BASE), dtype=np.uint64)))
    inverse = pow(_BASE, -1, 1 << 64)
    return (sums[size:] - sums[:-size]) * _powers(len(ids) - size + 1, inverse)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted, non-empty ``table``."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def tiles(item: np.ndarray, doc: np.ndarray, least: int, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(start in item, start in doc, length)`` of non-overlapping equal runs.

    Longest matches are marked first, down to ``least`` ids. For each search length the unmarked
    windows of the document are hashed and those of the item looked up; hits are verified and grown
    over unmarked ids. A match of more than twice the search length restarts the search at its
    length; afterwards the length is halved down to ``least``. Ties go to the earliest place.
    """
    marked_item, marked_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(first, len(item)))
    while True:
        found: list[tuple[int, int, int]] = []
        restart = 0
        doc_hashes, item_hashes = window_hashes(doc, size), window_hashes(item, size)
        hit = np.flatnonzero(among(doc_hashes, np.sort(item_hashes))) if len(item_hashes) else []
        places: dict[int, list[int]] = defaultdict(list)
        for d in map(int, hit):
            if not marked_doc[d : d + size].any():
                places[int(doc_hashes[d])].append(d)
        for i, h in enumerate(item_hashes.tolist()):
            if h not in places or marked_item[i : i + size].any():
                continue
            for d in places[h]:
                # A run whose left neighbours match too has been found from there.
                if i and d and item[i - 1] == doc[d - 1] and not marked_item[i - 1] and not marked_doc[d - 1]:
                    continue
                if not np.array_equal(item[i : i + size], doc[d : d + size]):
                    continue
                n = size
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not marked_item[i + n] and not marked_doc[d + n]:
                    n += 1
                if n > 2 * size:
                    restart = max(restart, n)
                found.append((n, i, d))
        if restart:
            size = restart
            continue
        # Longest first; a match that a longer one has cut into gives its free remainder to a later round.
        found.sort(key=lambda m: (-m[0], m[1], m[2]))
        again = False
        for n, i, d in found:
            if marked_item[i : i + n].any() or marked_doc[d : d + n].any():
                again = True
                continue
            marked_item[i : i + n] = True
            marked_doc[d : d + n] = True
            out.append((i, d, n))
        if again:
            continue
        if size == least:
            return out
        size = max(least, size // 2)


class Items:
    """A block of benchmark items: token ids and the seeds they share with documents."""

    def __init__(self, rows: list[tuple[int, str]], least: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in rows:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens(text)], np.int64)
            if not len(ids):
                continue
            size = min(least, len(ids))
            for h in set(window_hashes(ids, size).tolist()):
                seeds[size][h].add(len(self.items))
            self.items.append((item_id, ids, size))
        self.seeds = {size: (np.array(sorted(of), np.uint64), dict(of)) for size, of in seeds.items()}

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, float]]:
        """``(item_id, covered share)`` of the items that tile at least ``coverage`` of their tokens in ``text``."""
        known = self.vocabulary.get
        ids = np.array([known(t, -1) for t in tokens(text)], np.int64)
        shared: dict[int, set[int]] = defaultdict(set)
        for size, (hashes, of) in self.seeds.items():
            if len(ids) < size:
                continue
            here = ids >= 0
            runs = np.cumsum(np.concatenate(([0], here)))
            inside = np.flatnonzero(runs[size:] - runs[:-size] == size)
            if not len(inside):
                continue
            h = window_hashes(ids, size)[inside]
            for seed in set(h[among(h, hashes)].tolist()):
                for k in of[seed]:
                    shared[k].add(seed)
        out = []
        for k, found in shared.items():
            item_id, item, size = self.items[k]
            # No tiling covers more than the shared seeds do.
            reach = np.zeros(len(item) + 1, np.int64)
            starts = np.flatnonzero(among(window_hashes(item, size), np.array(sorted(found), np.uint64)))
            np.add.at(reach, starts, 1)
            np.add.at(reach, starts + size, -1)
            if (np.cumsum(reach[:-1]) > 0).mean() < coverage:
                continue
            share = sum(n for _, _, n in tiles(item, ids, size)) / len(item)
            if share >= coverage:
                out.append((item_id, share))
        return out


def _blocks(ws: Workspace, benchmark: DataFrame, key: str, text: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size; a longer single item is a block of its own."""
    rows = ws.stage(benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null"), "items")
    block: list[tuple[int, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if block and size + len(row.t) > chars:
            yield block
            block, size = [], 0
        block.append((row.k, row.t))
        size += len(row.t)
    if block:
        yield block


def leaks(
    ws: Workspace,
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
    least: int = MIN_TILE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, contaminated, item_id, coverage, n_items`` for every row of ``docs``.

    A document is contaminated if the tiles of some item, each ``least`` tokens or longer, cover the
    share ``coverage`` of the item, in whatever order they stand; of items with fewer tokens the
    whole must stand in one piece. ``item_id`` is the best covered item, ties to the smallest. Items
    without tokens match nothing, nor do null and empty texts. Repeated items count one each; a null
    item key comes last. The benchmark is sent out in blocks of bounded size, one pass over the
    documents each, so its size does not matter; a document meets only items that share a seed with it.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # A row is known by its key and 128 bits that stand for its text; rows that agree in both have one result.
    marks = [F.xxhash64("text").alias("p"), F.xxhash64(F.lit(7), "text").alias("q")]
    marked = spread_rows(rows).select("doc_id", "text", *marks)
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(ws, benchmark, item_key, item_text, block_chars)
    block, after = next(blocks, []), next(blocks, None)
    schema = "item_id long, coverage double, n_items long, doc_id long, p long, q long"

    def matched(sent: Broadcast, every: bool) -> DataFrame:
        """The best item, its coverage and the number of items found, of ``every`` row or of those with any."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, least)
            for batch in batches:
                best, rows_out = [], []
                for i, t in enumerate(texts_of(batch["text"])):
                    found = items.matches(t, coverage)
                    if found or every:
                        top = min(found, key=lambda m: (-m[1], m[0] is None, m[0] or 0), default=(None, None))
                        best.append((*top, len(found)))
                        rows_out.append(i)
                kinds = (pa.int64(), pa.float64(), pa.int64())
                columns = [pa.array([b[i] for b in best], kind) for i, kind in enumerate(kinds)]
                kept = batch.select(["doc_id", "p", "q"]).take(pa.array(rows_out, pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, *kept.columns], ["item_id", "coverage", "n_items", "doc_id", "p", "q"])

        return marked.mapInArrow(run, schema)

    if after is None:
        merged = matched(sc.broadcast(block), True)
        return merged.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "item_id", "coverage", "n_items")
    found = None
    while block is not None:
        sent = sc.broadcast(block)
        hits = ws.stage(matched(sent, False).distinct(), "hits")
        sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
        block, after = after, next(blocks, None)
    order = F.struct((-F.col("coverage")).alias("c"), F.col("item_id").isNull().alias("n"), F.col("item_id").alias("i"))
    name = F.concat_ws(" ", null_safe("doc_id"), F.col("p").cast("string"), F.col("q").cast("string")).alias("row")
    agreed = found.select(name, order.alias("o"), "n_items").groupBy("row").agg(F.min("o").alias("top"), F.sum("n_items").alias("n"))
    agreed = ws.stage(agreed.select("row", F.col("top.i").alias("item_id"), (-F.col("top.c")).alias("coverage"), "n"), "agreed")
    n_items = F.coalesce("n", F.lit(0)).cast("long")
    return lookup_join(rows.select("doc_id", *marks).select("doc_id", name), agreed, "row", "left").select(
        "doc_id", (n_items > 0).alias("contaminated"), "item_id", "coverage", n_items.alias("n_items")
    )


def clean(ws: Workspace, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null key stay."""
    found = leaks(ws, docs, benchmark, key, text).where("contaminated and doc_id is not null")
    found = ws.stage(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return lookup_join(docs, found, key, "left_anti")
