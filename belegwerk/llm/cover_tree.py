"""Exact top-k search by inner product, with cover trees over both queries and candidates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belegwerk.workspace import Workspace

K = 10
SCALE = 1024
LEAF = 32
BASE = 1.5
BLOCK = 8192
EXACT = float(1 << 53)


@dataclass
class Node:
    """A ball of points: rows ``low`` to ``high`` of the ordered vectors, within ``radius`` of ``centre``."""

    low: int
    high: int
    centre: np.ndarray
    radius: float
    length: float
    children: list[Node] = field(default_factory=list)
    # Centres, radii and lengths of the children, side by side.
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None
    lengths: np.ndarray | None = None


class CoverTree:
    """A cover tree: the children of a ball are centres more than a level's radius apart that cover it.

    A ball has 16 centres at most. Where these do not reach all points, as is common in many dimensions,
    a point goes to its nearest centre and the children do not cover at the level's radius. Results stay
    exact, for the search prunes by measured radii.
    The level's radius falls by ``BASE`` from parent to child, and a parent's centre is the centre of
    its first child. Small balls, and balls of equal points, stay leaves. For the bounds each node keeps
    the ball around the mean of its points, which is the tighter one. ``rows`` has the vectors in the
    order of the leaves, ``ids`` their keys.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        self.leaf = leaf
        self.points = vectors
        self.order = np.arange(len(vectors))
        root = vectors[0] if len(vectors) else np.zeros(vectors.shape[1])
        self.root = self._build(0, len(vectors), root)
        self.rows, self.ids = vectors[self.order], ids[self.order]

    def _build(self, low: int, high: int, centre: np.ndarray) -> Node:
        members = self.order[low:high]
        points = self.points[members]
        squares = (points * points).sum(1)
        away = _distances(points, squares, centre)
        radius = float(away.max(initial=0.0))
        middle = points.mean(0) if len(points) else centre
        tight = float(_distances(points, squares, middle).max(initial=0.0)) * (1 + 1e-9) + 1e-3
        node = Node(low, high, middle, tight, float(np.linalg.norm(middle)))
        if high - low <= self.leaf or radius == 0:
            return node
        # Farthest points first, until every point is within the level's radius of some centre. If
        # that needs too many centres, the points are about equally far apart and more levels gain nothing.
        reach, most = radius / BASE, 16
        owner, nearest, centres = np.zeros(len(members), np.int64), away, [centre]
        while nearest.max() > reach and len(centres) < most:
            new = points[int(nearest.argmax())]
            d = _distances(points, squares, new)
            closer = d < nearest
            owner[closer], nearest = len(centres), np.where(closer, d, nearest)
            centres.append(new)
        order = np.argsort(owner, kind="stable")
        self.order[low:high] = members[order]
        sizes = np.bincount(owner, minlength=len(centres))
        if sizes.max() == len(members):
            return node
        at = low
        for c, size in zip(centres, sizes):
            if size:
                node.children.append(self._build(at, at + int(size), c))
                at += int(size)
        node.centres = np.stack([c.centre for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.lengths = np.array([c.length for c in node.children])
        return node


def _distances(points: np.ndarray, squares: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares - 2 * (points @ centre) + centre @ centre, 0))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors held as doubles; whole sums below 2**53 are exact in doubles."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if largest < EXACT:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def dual_tree(queries: CoverTree, candidates: CoverTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query row its ``k`` best scores and their keys; unused places score the least integer.

    A pair of balls is left when the most that any of its products can be, from the centres' product,
    the covering radii and the centres' lengths, is below the worst k-th score of the query ball.
    Equal scores are looked at, for the smaller key wins. A row is no candidate of its own query.
    """
    none, last = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    n = len(queries.ids)
    best = np.full((n, k), none, np.int64)
    keys = np.full((n, k), last, np.int64)

    def bounds(node: Node, other: Node) -> np.ndarray:
        """The most that products between each child of ``node`` and ``other`` can be."""
        most = node.centres @ other.centre + other.radius * (node.lengths + node.radii) + node.radii * other.length
        return most + 1e-9 * np.abs(most) + 1e-6

    stack = [(np.inf, queries.root, candidates.root)] if n and len(candidates.ids) else []
    while stack:
        most, q, r = stack.pop()
        worst = best[q.low : q.high, -1]
        if most < worst.min():
            continue
        if q.children or r.children:
            # The larger ball is opened; the most promising pair is looked at first.
            if not q.children or (r.children and r.radius >= q.radius):
                pairs = [(m, q, c) for m, c in zip(bounds(r, q).tolist(), r.children)]
            else:
                pairs = [(m, c, r) for m, c in zip(bounds(q, r).tolist(), q.children)]
            stack += sorted((p for p in pairs if p[0] >= worst.min()), key=lambda p: p[0])
            continue
        scores = products(queries.rows[q.low : q.high], candidates.rows[r.low : r.high])
        if (scores < worst[:, None]).all():
            continue
        ids = np.broadcast_to(candidates.ids[r.low : r.high], scores.shape)
        scores = np.where(ids == queries.ids[q.low : q.high, None], none, scores)
        s = np.concatenate((best[q.low : q.high], scores), axis=1)
        i = np.concatenate((keys[q.low : q.high], np.where(scores == none, last, ids)), axis=1)
        top = np.lexsort((i, np.invert(s)), axis=1)[:, :k]
        best[q.low : q.high] = np.take_along_axis(s, top, 1)
        keys[q.low : q.high] = np.take_along_axis(i, top, 1)
    return best, keys


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)


def search(
    ws: Workspace,
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    k: int = K,
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query, ties to smaller keys.

    Queries are the rows whose key is divisible by ``every``; candidates are all rows with another
    key. Components become ``floor(scale * x)``. Rows with a null key, a null or empty vector, or a null or
    non-finite component take no part; vectors meet those of their own length only. Repeated rows are
    candidates each, but one query: a repeated query row asks nothing new. A query key that stands with several
    vectors asks with all of them, and has the best scores of any. Candidates and queries are dealt into blocks of about ``block`` rows; every pair of
    blocks is searched with one tree on either side, and the lists of a query are merged.
    """
    x = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0) & sound).select(F.col(key).cast("long").alias("id"), x.alias("v"))
    rows = ws.stage(rows.withColumn("dim", F.size("v")), "vectors")
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    n, n_asked = rows.count(), asked.count()
    r_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_asked // block))
    own = F.pmod(F.xxhash64("id"), F.lit(r_blocks))
    near = F.pmod(F.xxhash64("id"), F.lit(q_blocks))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = asked.select("id", "v", "dim", near.alias("q"), each(r_blocks).alias("r"))
    right = rows.select("id", "v", "dim", own.alias("r"), each(q_blocks).alias("q"))

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(queries) or not len(candidates):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        q = CoverTree(_matrix(queries), queries["id"].to_numpy(np.int64))
        best, keys = dual_tree(q, CoverTree(_matrix(candidates), candidates["id"].to_numpy(np.int64)), k)
        used = best != np.iinfo(np.int64).min
        return pd.DataFrame({"query_id": np.repeat(q.ids, used.sum(1)), "vec_id": keys[used], "score": best[used]})

    groups = ["dim", "q", "r"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(meet, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH rows AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT q.id AS query_id, r.id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT id, v FROM rows) q JOIN rows r ON q.id <> r.id AND len(q.v) = len(r.v) WHERE q.id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
