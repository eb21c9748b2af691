"""Documents linked by the Jaccard similarity of their shingle sets: a metric-space join over pivot regions.

The Jaccard distance is a metric. Two texts within ``EPS`` of each other have distances to any third
one, a pivot, that differ by ``EPS`` at most. So a region is split among pivots: each document goes to its
nearest pivot (its Voronoi cell), and also to all pivots at most ``2 EPS`` farther away, which is as far as a
partner in another cell can be. Regions are split until they are small, and then joined whole.

Unrelated texts are all at a distance of about 1 from any pivot, and then no window leaves anything out. So
the first pivots are not drawn at random: each shingle that is rare enough to matter makes the
first document that holds it a pivot, and the region of a pivot is whoever shares such a shingle with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belegwerk.llm.common import spread_rows, texts_of, words
from belegwerk.llm.components import components
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace, empty, shuffles_dropped

SHINGLE = 4
PERCENT = 85
SEED = 42
# Shingles whose hash lies in this share of all are counted over the corpus; the rarest of them come first.
BAND = 0.22
# Leading bits of a shingle's hash that stand for it where partners are looked for: what is moved most is kept short.
BITS = 48
# A region of at most so many documents and shingles is joined by one task.
LEAF = 512
LEAF_SHINGLES = 4 << 20
# Documents of a larger region that meet its pivots in one task, and pivots of a split.
SLICE = 1024
PIVOTS = 8
# Rounds of splitting; regions that are still large are joined block by block.
ROUNDS = 6
# A region is split further while its open cells have at most so many times its documents.
GAIN = 1.5
# Documents that a task compares directly.
DIRECT = 64
# Columns of the incidence matrix at a time.
COLUMNS = 4096
# Digests of texts that a task remembers, so that copies send their shingles once.
REMEMBERED = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles; of fewer words the whole sequence is one."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(t, SEED) for t in tokens], np.uint64)
    size = min(shingle, len(h))
    grams = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        grams = _mixed(grams * np.uint64(_FACTOR) + h[i : i + len(grams)])
    return np.unique(grams)


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of ``n`` has with any partner."""
    return -(-n * percent // 100)


def can_link(n: int, percent: int = PERCENT) -> bool:
    """Whether a set of ``n`` can have a partner other than an equal set."""
    return n * 100 // percent > n or 100 * (n - 1) >= percent * n


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def described(docs: DataFrame, shingle: int, percent: int, salt: int) -> DataFrame:
    """``doc_id, n, x, y, i, have, held`` for every row: its set's size, 128 bits that stand for the set, the row's number, and the shingles it is found by.

    ``held`` are the set's hashes in the band, at least as many as the prefix needs: a set and its partner share
    one of the first ``n - needed(n) + 1`` shingles of either, in any order that holds for all sets. Of each hash
    the first ``BITS`` are held. Shingles that agree in them are one here, which can only add to who meets.
    """
    limit = int(BAND * (1 << BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        # Rows of a task have near numbers, so that numbers take little room in a shuffle, whatever its partitions.
        start = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, marks, held = [], [], []
            for text in texts_of(batch["text"]):
                s = shingle_set(text, shingle)
                mark = hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
                sizes.append(len(s))
                marks.append(mark)
                if mark in seen or not can_link(len(s), percent):
                    held.append(s[:0])
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(mark)
                least = len(s) - needed(len(s), percent) + 1
                s = s >> np.uint64(64 - BITS)
                held.append(np.unique(s[: max(least, int(np.searchsorted(s, np.uint64(limit))))]))
            pairs = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(_signed(np.concatenate(held) if held else np.zeros(0, np.uint64))))
            numbers, start = pa.array(np.arange(start, start + len(sizes), dtype=np.int64)), start + len(sizes)
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), numbers, pa.array(np.diff(ends)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "x", "y", "i", "have", "held"])

    return spread_rows(docs).mapInArrow(run, "doc_id long, n long, x long, y long, i long, have int, held array<long>")


def held_shingles(ws: Workspace, sets: DataFrame) -> DataFrame:
    """``s, i``: the shingles held, each by one row ``i`` of every class of equal sets."""
    holders = sets.where("have > 0")
    first = holders.groupBy("x").agg(F.min("i").alias("first"), F.max("i").alias("last")).where("first < last")
    copies = ws.stage(holders.join(first, "x").where("i > first").select("i"), "copies")
    return lookup_join(holders.select("i", "held"), copies, "i", "left_anti").select(F.explode("held").alias("s"), "i")


def first_regions(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """``r, x, n``: who shares a rare shingle with which pivot ``r``; two that can link share a region.

    The order of shingles: those of the band by how many rows hold them, then by hash, then all others. A
    set whose prefix is made of shingles of its own has no partner and is left here, as most are.
    """
    rows = held_shingles(ws, sets)
    shared = ws.stage(rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    in_band = F.col("s") < int(BAND * (1 << BITS))
    place = F.struct((~in_band).alias("later"), F.when(in_band, F.col("c")).otherwise(0).alias("c"), "s")
    lists = rows.join(shared, "s").select("i", "c", "s").repartition("i").groupBy("i").agg(F.collect_list(place).alias("l"))
    lists = lists.join(sets.where("have > 0").select("i", "x", "n", "have"), "i")
    # What is not shared comes first in the band; beyond it, all that is held belongs to the prefix.
    own = F.col("have") - F.size("l")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lists = lists.withColumn("take", F.least(prefix - own, F.size("l").cast("long")).cast("int")).where("take > 0")
    chosen = lists.select("x", "n", F.explode(F.slice(F.sort_array("l"), F.lit(1), F.col("take"))).alias("p")).select("x", "n", F.col("p.s").alias("s"))
    chosen = ws.stage(chosen, "prefixes")
    owners = chosen.groupBy("s").agg(F.min("x").alias("r"), F.max("x").alias("high")).where("r < high").select("s", "r")
    found = ws.stage(chosen.join(owners, "s").select("r", "x", "n").distinct(), "regions")
    # Of a region of two the sizes tell at times that they are no pair.
    lone = found.groupBy("r").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most"))
    lone = lone.where((F.col("m") == 2) & (F.col("least") * 100 < F.col("most") * percent)).select("r")
    return ws.stage(found.join(lone, "r", "left_anti"), "regions")


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets), np.cumsum(np.concatenate(([0], sizes[:-1]))), sizes


def overlaps_with(pivots: list[np.ndarray], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of each pivot (row) with each set (column)."""
    values, starts, sizes = _flat(sets)
    both = np.zeros((len(pivots), len(sets)), np.int64)
    for i, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(p, values), len(p) - 1)
        both[i] = np.add.reduceat(p[at] == values, starts, dtype=np.int64)
    either = np.array([len(p) for p in pivots], np.int64)[:, None] + sizes[None, :] - both
    return both, either


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all intersections and unions, through an incidence matrix of the shared shingles."""
    values, _, sizes = _flat(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    doc, place = doc[keep], (np.cumsum(count > 1) - 1)[place[keep]]
    order = np.argsort(place, kind="stable")
    doc, place = doc[order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        matrix = np.zeros((len(sets), COLUMNS), np.float32)
        matrix[doc[a:b], place[a:b] - low] = 1
        both += matrix @ matrix.T
    both = both.astype(np.int64)
    np.fill_diagonal(both, sizes)
    return both, sizes[:, None] + sizes[None, :] - both


class Classes:
    """Which of a region's documents are known to be connected."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)

    def one(self, members: np.ndarray) -> bool:
        first = self.find(int(members[0])) if len(members) else 0
        return all(self.find(i) == first for i in members.tolist())


def cells(both: np.ndarray, either: np.ndarray, percent: int) -> np.ndarray:
    """Which documents (columns) stand in which pivots' regions: the nearest pivot's and all within the window."""
    away = 1 - both / np.maximum(either, 1)
    return away <= away.min(axis=0) + 2 * (1 - percent / 100) + 1e-9


def join_region(sets: list[np.ndarray], percent: int = PERCENT, direct: int = DIRECT) -> Classes:
    """The classes of documents that are connected by links within one region."""
    known = Classes(len(sets))

    def compare(members: np.ndarray) -> None:
        both, either = overlaps([sets[i] for i in members])
        for i, j in zip(*np.nonzero(np.triu(both * 100 >= either * percent, 1))):
            known.join(int(members[i]), int(members[j]))

    def split(members: np.ndarray) -> None:
        if len(members) < 2 or known.one(members):
            return
        if len(members) <= direct:
            compare(members)
            return
        step = len(members) // PIVOTS
        pivots, rest = members[::step][:PIVOTS], np.delete(members, np.arange(PIVOTS) * step)
        both, either = overlaps_with([sets[i] for i in pivots], [sets[i] for i in members])
        for p, near in zip(pivots.tolist(), both * 100 >= either * percent):
            for i in members[near].tolist():
                known.join(p, i)
        inside = cells(both, either, percent)[:, np.isin(members, rest)]
        parts = [rest[c] for c in inside if c.any()]
        # Where the windows leave nothing out, a split gains nothing.
        if any(len(p) > 0.9 * len(rest) and not known.one(p) for p in parts):
            compare(rest)
            return
        for part in parts:
            split(part)

    split(np.arange(len(sets)))
    return known


def _sets_of(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(v, np.int64).view(np.uint64) for v in column]


def _join_groups(members: DataFrame, by: list[str], percent: int) -> DataFrame:
    """``u, v``: links from each document to the first of its class, of regions that a task joins whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        known, ids = join_region(_sets_of(pdf["s"]), percent), pdf["x"].to_numpy()
        roots = np.array([known.find(i) for i in range(len(ids))], np.int64)
        linked = np.flatnonzero(roots != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[linked], "v": ids[roots[linked]]})

    return members.groupBy(*by).applyInPandas(run, "u long, v long")


def _slices(members: DataFrame, sets: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """``r, x, p, near, inside``: documents of large regions against the pivots, slice by slice."""
    schema = "r long, x long, p long, near boolean, inside boolean"

    def run(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(chosen):
            return pd.DataFrame({"r": [], "x": [], "p": [], "near": [], "inside": []}).astype({"r": "int64", "x": "int64", "p": "int64", "near": bool, "inside": bool})
        chosen = chosen.sort_values("p")
        both, either = overlaps_with(_sets_of(chosen["ps"]), _sets_of(rows["s"]))
        p, x = chosen["p"].to_numpy(), rows["x"].to_numpy()
        near = both * 100 >= either * percent
        inside = cells(both, either, percent) & ~np.isin(x, p)[None, :]
        i, j = np.nonzero(near | inside)
        return pd.DataFrame({"r": rows["r"].iloc[0], "x": x[j], "p": p[i], "near": near[i, j], "inside": inside[i, j]})

    left = members.join(sets, "x").groupBy("r", "slice")
    right = pivots.join(sets.withColumnsRenamed({"x": "p", "s": "ps"}), "p").groupBy("pr", "pslice")
    return left.cogroup(right).applyInPandas(run, schema)


def _by_blocks(ws: Workspace, rows: DataFrame, sets: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Links within regions ``r, x, n`` of any size: each pair of blocks of a region is joined by one task."""
    sizes = rows.groupBy("r").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") * 2 / leaf), F.ceil(F.col("total") * 2 / LEAF_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(sizes.select("r", blocks.alias("blocks")), "r").select("r", "x", own.alias("own"), other.alias("other"))
    dealt = dealt.select("r", "x", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return ws.stage(_join_groups(dealt.join(sets, "x"), ["r", "i", "j"], percent), "links")


def _sizes(ws: Workspace, regions: DataFrame, leaf: int) -> DataFrame:
    """``r, m, total, small``: the regions ``r, x, n`` of two documents or more, and whether a task joins them whole."""
    sizes = regions.groupBy("r").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    # Two documents meet whatever their length.
    small = (F.col("m") <= leaf) & ((F.col("total") <= LEAF_SHINGLES) | (F.col("m") == 2))
    return ws.stage(sizes.withColumn("small", small), "sizes")


def linked(ws: Workspace, regions: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int = PERCENT, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """Edges ``u, v`` that connect what is connected by links within the regions ``r, x, n`` of the given sizes.

    ``sets`` is ``x, s, rs``; ``rs`` are the small regions that a document is in, so that its set goes
    to them without a join.

    Regions of at most ``leaf`` documents are joined by one task each. Larger ones are split at ``PIVOTS``
    pivots: the documents meet the pivots in slices, links to pivots are kept, and the cells become the
    next round's regions, but for those whose documents are all connected already. What is still large
    after ``rounds`` is joined block by block, each pair of blocks by one task.
    """
    edges = [empty(ws.spark, "u long, v long")]
    now, ready = regions, sets.select(F.explode("rs").alias("r"), "x", "s")
    sets = sets.select("x", "s")
    for turn in range(rounds + 1):
        if turn:
            sizes = _sizes(ws, now, leaf)
            ready = now.join(sizes.where("small").select("r"), "r", "left_semi").join(sets, "x")
        edges.append(ws.stage(_join_groups(ready, ["r"], percent), "links"))
        large = sizes.where("not small").select("r", "m", "total")
        if large.isEmpty():
            break
        rows = now.join(large, "r")
        if turn == rounds:
            edges.append(_by_blocks(ws, rows.select("r", "x", "n"), sets, percent, leaf))
            break
        slices = F.greatest(F.ceil(F.col("m") / SLICE), F.ceil(F.col("total") / LEAF_SHINGLES)).cast("int")
        rows = ws.stage(rows.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("x"), F.col("slices")).cast("int")), "rows")
        order = Window.partitionBy("r").orderBy(F.xxhash64(F.lit(turn), "x"), "x")
        pivots = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS)
        pivots = pivots.select(F.col("r").alias("pr"), F.col("x").alias("p"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("pslice"))
        met = ws.stage(_slices(rows.select("r", "slice", "x"), sets, pivots, percent), "met")
        edges.append(met.where("near and x <> p").select(F.col("x").alias("u"), F.col("p").alias("v")))
        so_far = edges[0]
        for more in edges[1:]:
            so_far = so_far.unionByName(more)
        roots = components(ws, so_far)
        parts = met.where("inside").select("r", F.xxhash64("r", "p").alias("cell"), "x").join(roots, F.col("x") == F.col("node"), "left")
        parts = ws.stage(parts.select("r", "cell", "x", F.coalesce("root", "x").alias("root")), "cells")
        cells_left = parts.groupBy("r", "cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("c"))
        cells_left = ws.stage(cells_left.where("low < high").select("r", "cell", "c"), "open")
        # Where windows leave too little out, a further split would only copy the region.
        stalled = cells_left.groupBy("r").agg(F.sum("c").alias("copies")).join(large.select("r", "m"), "r")
        stalled = ws.stage(stalled.where(F.col("copies") > F.lit(GAIN) * F.col("m")).select("r"), "stalled")
        left = parts.join(cells_left.select("r", "cell"), ["r", "cell"], "left_semi")
        left = ws.stage(left.join(rows.select("r", "x", "n"), ["r", "x"]).select("r", "cell", "x", "n"), "left")
        if not stalled.isEmpty():
            whole = left.join(stalled, "r", "left_semi").select("r", "x", "n").distinct()
            edges.append(_by_blocks(ws, ws.stage(whole, "whole"), sets, percent, leaf))
        now = left.join(stalled, "r", "left_anti").select(F.col("cell").alias("r"), "x", "n").distinct()
        now = ws.stage(now, "regions")
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def join(
    ws: Workspace,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    leaf: int = LEAF,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A row's set is that of its different word shingles, A-Z lower-cased; with fewer words than a shingle the
    whole sequence is the only one. Rows are linked if their sets have a Jaccard similarity of at least
    ``percent`` percent, exactly; ``component_id`` is the smallest key reachable. A null or empty text, or one
    without words, has an empty set, is linked with nothing and has its own key. Rows with a null key
    link like any other but name no component, unless all of it have none: then it is null. Repeated rows each get a
    row. An empty table gives an empty one.

    Sets are compared as 64-bit hashes of shingles. Equal sets are one from the start. Only the sets of
    documents that share a rare shingle with another are worked out again and moved.
    """
    with shuffles_dropped(ws.spark):
        rows, classes, named = _named(ws, docs, key, text, shingle, percent, leaf, rounds)
    # Most classes are their own component: only the linked ones need a second look.
    all_named = classes.select("x", "least").join(named, "x", "left").select("x", F.coalesce("component", "least").alias("component"))
    out = rows.where("n > 0").select("doc_id", "n", "x").join(all_named, "x").select("doc_id", "n", "component")
    bare = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    return out.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _named(ws: Workspace, docs: DataFrame, key: str, text: str, shingle: int, percent: int, leaf: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: the rows ``doc_id, n, x``, the classes ``x, least``, and ``x, component`` of the classes that are linked."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    salt = 0
    while True:
        rows = ws.stage(described(source, shingle, percent, salt), "sets", "zstd")
        classes = rows.where("n > 0").groupBy("x").agg(F.min("doc_id").alias("least"), F.min("y").alias("y"), F.max("y").alias("other"))
        classes = ws.stage(classes, "classes")
        # 64 bits name a class; should two ever share them, the next salt parts them.
        if classes.where("y <> other").isEmpty():
            break
        salt += 1
    regions = first_regions(ws, rows, percent)
    sizes = _sizes(ws, regions, leaf)
    # Nulls, of regions that are not small, are not collected.
    goes = regions.join(sizes.where("small").select("r", F.col("r").alias("to")), "r", "left")
    goes = goes.groupBy("x").agg(F.collect_list("to").alias("rs"))
    wanted = ws.stage(goes.join(classes.select("x", "least"), "x"), "wanted")
    ids = ws.stage(wanted.where("least is not null").select(F.col("least").alias("doc_id")).distinct(), "ids")
    texts = lookup_join(source, ids, "doc_id", "left_semi")
    if not wanted.where("least is null").isEmpty():
        texts = texts.unionByName(source.where("doc_id is null"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in texts_of(batch["text"])]
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()[:8] for s in sets]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(_signed(np.concatenate(sets) if sets else np.zeros(0, np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(marks), "<i8")), lists], ["x", "s"])

    sets = texts.select("text").mapInArrow(again, "x long, s array<long>").join(wanted.select("x", "rs"), "x")
    sets = ws.stage(sets.dropDuplicates(["x"]), "arrays")
    found = components(ws, linked(ws, regions, sizes, sets, percent, leaf, rounds))
    member = ws.stage(classes.join(found, classes["x"] == found["node"]).select("x", "least", "root"), "members")
    roots = classes.join(member.select(F.col("root").alias("x")).distinct(), "x", "left_semi").select("x", "least", F.col("x").alias("root"))
    member = member.unionByName(roots)
    tops = member.groupBy("root").agg(F.min("least").alias("component"))
    named = ws.stage(member.join(tops, "root").select("x", "component"), "named")
    return rows, classes, named
