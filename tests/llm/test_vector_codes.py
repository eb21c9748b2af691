import hashlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from belegwerk.llm import vector_codes


def plain(rows, parts, entries, rounds):
    """Codes, errors and digest with Python's integers only; ``rows`` is ``(id, ints)`` in id order."""
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for e, xs in held.items():
                books[p][e] = [floor(Fraction(sum(col), len(xs))) for col in zip(*xs)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, found)}, digest


@pytest.mark.parametrize("scale", [1.0, 600_000.0])
def test_same_as_integers(spark, ws, scale):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 8)) * scale / 4).clip(-scale, scale)
    v[100:200] = v[:100]
    rows = [(1000 - i, x.tolist(), None if i % 3 == 0 else i % 4) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = vector_codes.compress(ws, frame, entries=10, parts=4).collect()
    ints = sorted((i, [floor(256 * x) for x in e]) for i, e, _ in rows)
    want, digest = plain(ints, 4, 10, 2)
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    labels = {i: n for i, _, n in rows}
    for r in got:
        assert r.label_error == sum(e for i, (_, e) in want.items() if labels[i] == labels[r.vec_id])


def test_products_beyond_doubles():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 29), 1 << 29, (3, 5, 4)), rng.integers(-(1 << 29), 1 << 29, (3, 4, 7))
    a[0, 0] = b[0, :, 0] = (1 << 29) - 1
    want = np.einsum("pij,pjk->pik", a.astype(object), b.astype(object))
    assert (vector_codes.exact_products(a, b) == want).all()
    assert (a[0] @ b[0]).dtype == np.int64 and ((a[0].astype(float) @ b[0].astype(float)).astype(object) != want[0]).any()
    assert len(vector_codes.limbs(np.array([255, -256]), 25)) == 1
    assert 4 * (1 << 2 * vector_codes.limb_bits(4)) <= 1 << 53


def test_odd_rows(spark, ws):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [0.5, 0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [-inf, 1.0]), (6, [None, 1.0]), (None, [3.0, 3.0]), (7, [1.0]), (8, [1e30, -1e30]), (9, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(*r, r[0] and r[0] % 2, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int")
    got = vector_codes.compress(ws, frame, entries=2, parts=2).collect()
    assert len(got) == 7 and len({r.codebooks_sha256 for r in got}) == 1
    assert {r.vec_id for r in got if r.code is None} == {7, 8, 9}
    assert {r.code for r in got if r.vec_id == 1} == {"0000", "0001"}
    assert [r.label_error for r in got if r.vec_id is None] == [r.error for r in got if r.vec_id is None]
    assert {r.label_error for r in got if r.vec_id == 8} == {None}
    assert vector_codes.compress(ws, frame.limit(0)).count() == 0
    only = frame.where("vec_id in (2, 3, 8)")
    assert [r.code for r in vector_codes.compress(ws, only).collect()] == [None]
