"""SimHash fingerprints and near-duplicate classes by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.common import spread_rows, texts_of, words
from belegwerk.llm.components import components
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
# Votes are counted in blocks, so a very long text needs no more memory than a block.
BLOCK = 1 << 17
# A bucket of an index with more different fingerprints than this is linked through common points.
DENSE = 1000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    tokens = words(text)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends, at = [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    size = min(shingle, len(tokens))
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros(BITS, np.int64), len(tokens) - size + 1
    for low in range(0, total, BLOCK):
        high = min(total, low + BLOCK)
        spans = zip(starts[low:high], ends[low + size - 1 : high + size - 1])
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total).view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for every row; a null text counts as empty."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, shingle) for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return spread_rows(source).mapInArrow(run, "doc_id long, fp long")


def segments_for(n: int, radius: int = RADIUS) -> int:
    """How many segments make the index over ``n`` fingerprints cheapest; any number gives the same links.

    Wide segments have small buckets and large balls, narrow ones the other way round. Counted are
    the probes and the rows they meet when buckets are even.
    """

    def cost(m: int) -> float:
        width = BITS // m
        ball = sum(comb(width, r) for r in range(radius // m + 1))
        return m * ball * (1 + n / (1 << width))

    return min(range(1, radius + 1), key=cost)


def _probes(segment: int, value: Column, width: int, near: int) -> Column:
    """Buckets of one segment that a fingerprint looks into: its own, and larger ones within ``near`` bits."""
    flips = [sum(1 << b for b in c) for r in range(1, near + 1) for c in combinations(range(width), r)]
    own = F.array(F.struct(F.lit(segment).alias("s"), value.alias("k"), F.lit(True).alias("same")))
    if not flips:
        return own
    ball = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: value.bitwiseXOR(x))
    larger = F.filter(ball, lambda k: k > value)
    return F.concat(own, F.transform(larger, lambda k: F.struct(F.lit(segment).alias("s"), k.alias("k"), F.lit(False).alias("same"))))


def links(ws: Workspace, fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges ``u, v`` between different fingerprints: same components as linking all within ``radius``.

    Cut into ``m`` segments, two fingerprints within ``radius`` bits differ by at most
    ``radius // m`` bits in some segment. Each fingerprint stands in one bucket per segment and
    probes the buckets in the ball around its own; what meets is verified over all bits. Of two
    fingerprints only the one with the smaller segment probes, so a pair meets once a segment.

    A dense bucket (a large group of near copies) would give the square of its size. Its members
    are linked without pairs: two points lie within ``radius`` of each other exactly if some point is within half the
    radius, rounded down, of one and within the rest of it of the other. All in the larger ball around a
    point are linked to one in the smaller. So such members send out the points of their ball and become a star
    per point that has a near one; an even radius has two equal balls.
    """
    m = segments_for(n, radius)
    near = radius // m
    cuts = [(BITS * s // m, BITS * (s + 1) // m - BITS * s // m) for s in range(m)]
    home, probe = [], []
    for s, (shift, width) in enumerate(cuts):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        home.append(F.struct(F.lit(s).alias("s"), value.alias("k")))
        probe.append(_probes(s, value, width, near))
    homes = fps.select(F.col("fp").alias("v"), F.inline(F.array(*home)))
    dense = homes.groupBy("s", "k").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > DENSE)
    dense = ws.stage(dense, "dense")
    probes = fps.select(F.col("fp").alias("u"), F.inline(F.flatten(F.array(*probe))))
    sparse_homes, sparse_probes, hot = homes, probes, None
    if not dense.isEmpty():
        sparse_homes = homes.join(dense, ["s", "k"], "left_anti")
        hit = probes.join(dense.select("s", "k"), ["s", "k"], "left_semi").select(F.col("u").alias("fp"))
        hot = hit.union(homes.join(dense, ["s", "k"], "left_semi").select(F.col("v").alias("fp"))).distinct()
    pairs = sparse_probes.join(sparse_homes, ["s", "k"])
    pairs = pairs.where(
        (F.col("u") != F.col("v"))
        & (~F.col("same") | (F.col("u") < F.col("v")))
        & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    ).select("u", "v")
    if hot is None:
        return pairs
    # Of two fingerprints within the radius one lies in the small and one in the large ball around some point.
    low, high = radius // 2, radius - radius // 2
    points = [(r, _signed(sum(1 << b for b in c))) for r in range(high + 1) for c in combinations(range(BITS), r)]
    offers = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(r <= low).alias("near")) for r, x in points])
    ball = F.transform(offers, lambda o: F.struct(o.x.bitwiseXOR(F.col("fp")).alias("point"), o.near.alias("near")))
    spots = ws.stage(hot, "hot").repartition("fp").select("fp", F.inline(ball))
    centre = spots.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("u"), F.count(F.lit(1)).alias("c"))
    centre = centre.where("c > 1 and u is not null").select("point", "u")
    stars = spots.join(centre, "point").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    return pairs.union(stars)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(
    ws: Workspace, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fp, component_id, n_same`` for every row of ``docs``.

    Fingerprints within ``radius`` bits are linked; ``component_id`` is the smallest key reachable.
    Exact and equal fingerprints fall together before any search. A null or empty text has
    fingerprint zero and is linked like any other; a null key gets its component as well, but names
    none. Repeated rows each get a row. An empty table gives an empty table.
    """
    rows = ws.stage(fingerprints(docs, key, text, shingle), "fps")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same"))
    classes = ws.stage(classes, "classes")
    n = classes.count()
    found = components(ws, links(ws, classes.select("fp"), n, radius))
    member = classes.join(found, classes["fp"] == found["node"], "left")
    member = member.select("fp", "least", "n_same", F.coalesce("root", "fp").alias("root"))
    member = ws.stage(member, "members")
    # Only linked classes need a second look; all others are their own root and component.
    tops = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ws.stage(member.join(tops, "root").select("fp", "n_same", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "n_same")


def representatives(
    ws: Workspace, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate class: the one with its smallest key.

    Of repeated rows of that key one stays. Rows without a key cannot be told apart and all stay.
    """
    found = ws.stage(near_duplicates(ws, docs, key, text, shingle, radius), "found")
    # Those that go are fewer than those that stay: a small list is sent to the rows, a large one is shuffled.
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    gone = found.where("doc_id is not null").select("doc_id").distinct().join(stay, "doc_id", "left_anti")
    kept = lookup_join(docs, ws.stage(gone.withColumnRenamed("doc_id", key), "gone"), key, "left_anti")
    double = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not double.isEmpty():
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
    return kept
