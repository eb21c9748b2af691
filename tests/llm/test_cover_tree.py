import numpy as np
import pytest

from belegwerk.llm import cover_tree


def plain(ids, v, every, k):
    out = {}
    for i, q in zip(ids, v):
        if i % every == 0:
            scored = sorted((-int(q @ w), j) for j, w in zip(ids, v) if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    v = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, dims)) * 0.05
    v[: n // 4] = v[0]
    return v.astype(np.float32)


@pytest.mark.parametrize("dims", [2, 16])
@pytest.mark.parametrize("block", [100, 8192])
def test_same_as_all_products(spark, ws, dims, block):
    x = clustered(700, dims, dims)
    ids = list(range(0, 2100, 3))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    v = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    got = cover_tree.search(ws, frame, every=30, block=block).collect()
    want = plain(ids, v, 30, 10)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    assert found == want


def test_tree_covers_its_points_and_prunes():
    x = np.floor(1024 * clustered(2000, 8, 3).astype(np.float64))
    tree = cover_tree.CoverTree(x, np.arange(len(x)))

    def walk(node):
        rows = tree.rows[node.low : node.high]
        assert np.sqrt(((rows - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-6
        assert not node.children or (node.children[0].low, node.children[-1].high) == (node.low, node.high)
        for a, b in zip(node.children, node.children[1:]):
            assert a.high == b.low
        for child in node.children:
            walk(child)

    walk(tree.root)
    assert sorted(tree.ids.tolist()) == list(range(len(x)))


def test_sums_beyond_doubles():
    q = np.array([[float(1 << 28)] * 2]), np.array([[float((1 << 28) + 1)] * 2])
    assert cover_tree.products(*q)[0, 0] == 2 * (1 << 28) * ((1 << 28) + 1)


def test_odd_rows(spark, ws):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [-1.0, 0.5]), (100, [0.5]), (7, [1.0, 2.0]), (8, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score long")
    got = cover_tree.search(ws, frame).collect()
    assert {r.query_id for r in got} == {0}
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 7), (2, 8), (3, 6)]
    assert cover_tree.search(ws, frame.limit(0)).count() == 0
