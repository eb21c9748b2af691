"""Product codes of vectors: exact integer k-means, with distances from limb-split matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.common import fresh, null_safe
from belegwerk.operators.joins import lookup_join
from belegwerk.workspace import Workspace

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Doubles hold all integers up to here.
EXACT_BITS = 53
# Vectors whose distances stand in memory at once.
BATCH = 2048


def limb_bits(width: int) -> int:
    """The most bits of a limb such that ``width`` products of two limbs add up to at most 2**53."""
    return (EXACT_BITS - (width - 1).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as doubles ``l`` with ``values = sum(l[i] << bits * i)``; all but the last are not negative.

    There are as many as the largest value needs: one for values that need no split.
    """
    largest = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    out = []
    while largest >> bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
        largest = (largest >> bits) + 1
    return [*out, values.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of integer matrices (or stacks of them), exact as long as the sums fit into 64 bits.

    Every product of two limbs is one double precision matrix product whose sums stay below 2**53;
    these are shifted to their place and added in 64 bits.
    """
    bits = limb_bits(a.shape[-1])
    out = np.zeros(np.broadcast_shapes(a.shape[:-2], b.shape[:-2]) + (a.shape[-2], b.shape[-1]), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y).astype(np.int64) << np.int64(bits * (i + j))
    return out


def assign(points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the first of equal ones, and squared distance to it: both ``parts x rows``.

    ``points`` is ``parts x rows x width``, ``books`` is ``parts x entries x width``.
    """
    scores = (books * books).sum(2)[:, None, :] - 2 * exact_products(points, books.transpose(0, 2, 1))
    code = scores.argmin(axis=2)
    return code, np.take_along_axis(scores, code[:, :, None], 2)[:, :, 0] + (points * points).sum(2)


def _points(column: pa.Array, parts: int) -> Iterator[np.ndarray]:
    """``parts x rows x width`` of the vectors of a batch, some rows at a time."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, parts, -1)
    for low in range(0, rows, BATCH):
        yield np.ascontiguousarray(flat[low : low + BATCH].transpose(1, 0, 2))


def _sums(rows: DataFrame, books: np.ndarray) -> list:
    """``part, entry, n, place, total`` over all ``rows``: a bounded number of rows, as there are entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        offsets = np.arange(parts)[:, None] * entries
        for batch in batches:
            for points in _points(batch["v"], parts) if batch.num_rows else ():
                cell = (assign(points, books)[0] + offsets).ravel()
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.diff(cell[order], prepend=-1))
                used = cell[order][first]
                sums[used] += np.add.reduceat(points.reshape(-1, width)[order], first)
                n += np.bincount(cell, minlength=len(n))
        used = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), lists], ["cell", "n", "sums"])

    wide = rows.select("v").mapInArrow(run, "cell long, n long, sums array<long>")
    # Totals over all tasks need more than 64 bits for long tables of large components.
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return wide.groupBy("cell").agg(F.sum("n").alias("n"), *[total(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()


def train(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``parts x entries x width`` from ``id, v``; fewer rows than ``entries`` give fewer entries.

    The start is the vectors of the smallest ids (null last, equal ids by vector). In each round every
    task adds up the parts nearest to each entry, and the driver gets one total per entry and place.
    """
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    width = len(first[0].v) // parts if first else 1
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        flat = books.reshape(-1, books.shape[2]).copy()
        for r in _sums(rows, books):
            flat[r.cell] = [int(r[f"s{i}"]) // r.n for i in range(books.shape[2])]
        books = flat.reshape(books.shape)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    ws: Workspace,
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    entries: int = ENTRIES,
    parts: int = PARTS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id, code, error, label_error, label, codebooks_sha256`` for every row with a sound vector.

    Components become ``floor(scale * x)``; vectors are cut into ``parts`` equal runs, each of which is
    given the number of its nearest codebook entry, as two hex digits. ``error`` is the squared distance
    between vector and entries, ``label_error`` its sum over the rows of a label, null labels together.
    Null and empty vectors and those with null or non-finite components are left out. The length of
    the table is that of its smallest key's vector, among lengths that ``parts`` divides. A vector of
    another length, or with a component too large for distances in 64 bits (about 741,000 for
    64 components at the scale of 256), has no code: its row stays, ``code`` and ``error`` are null, and it has no part in the
    codebooks. Rows with a null or a repeated key are coded like any other; as a start, null keys
    come last and equal keys in the order of their vectors. A sum that 64 bits cannot hold is null.
    An empty table gives an empty one.
    """
    x = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where((F.size(vector) > 0) & sound).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), x.alias("v"))
    rows = ws.stage(rows, "vectors")
    fits = F.size("v") % parts == 0
    top = rows.where(fits).orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("dim")).first()
    dim = top.dim if top else parts
    # Squared distances of whole vectors stay below 2**63.
    reach = isqrt(((1 << 63) - 1) // dim) // 2
    held = (F.size("v") == dim) & F.forall("v", lambda c: (c < reach) & (c > -reach))
    coded, other = rows.where(held), rows.where(~held)
    books = train(coded, entries, parts, rounds)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = [], []
            for points in _points(batch["v"], parts):
                code, away = assign(points, books)
                codes += ["".join(f"{c:02x}" for c in row) for row in code.T.tolist()]
                errors.append(away.sum(0))
            columns = [batch["id"], batch["label"], pa.array(codes), pa.array(np.concatenate(errors))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    made = coded.mapInArrow(run, f"id long, label {kind}, code string, error long")
    bare = other.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    (group,) = fresh(made, "_label")
    made = ws.stage(made.unionByName(bare).withColumn(group, null_safe("label")), "codes")
    # One total per label, added up in each task first; a label may hold most of the rows.
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    sums = ws.stage(made.groupBy(group).agg(total), "labels")
    return lookup_join(made, sums, group).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", "label", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _round_sql(n: int) -> str:
    return f"""
assigned{n} AS (
  SELECT p, row_no, any_value(x) AS x, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT w.p, w.row_no, w.x, b.e, list_inner_product(b.c, b.c) - 2 * list_inner_product(w.x, b.c) AS d
    FROM parts w JOIN book{n} b ON w.p = b.p) GROUP BY p, row_no)"""


def _book_sql(n: int) -> str:
    return f"""
means{n} AS (
  SELECT p, e, list(CAST(floor(CAST(total AS DOUBLE) / n) AS DOUBLE) ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, sum(CAST(x[i] AS BIGINT)) AS total, count(*) AS n
    FROM assigned{n - 1}, (SELECT unnest(range(1, {64 // PARTS} + 1)) AS i) GROUP BY p, best.e, i) GROUP BY p, e),
book{n} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n - 1} b LEFT JOIN means{n} m ON b.p = m.p AND b.e = m.e)"""


# For vectors of 64 components.
SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (
  SELECT row_no, p, v[p * {64 // PARTS} + 1 : p * {64 // PARTS} + {64 // PARTS}] AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS (SELECT p, row_no - 1 AS e, x AS c FROM parts WHERE row_no <= {ENTRIES}),
{_round_sql(0)},
{_book_sql(1)},
{_round_sql(1)},
{_book_sql(2)},
{_round_sql(2)},
coded AS (
  SELECT row_no, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
         CAST(sum(best.d + list_inner_product(x, x)) AS BIGINT) AS error
  FROM assigned2 GROUP BY row_no),
whole AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256
  FROM book2)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, k.label,
       (SELECT codebooks_sha256 FROM whole) AS codebooks_sha256
FROM kept k JOIN coded c USING (row_no)
"""
