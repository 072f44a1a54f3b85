import math
import random

import numpy as np
import pytest

from peptaflow.llm.topk import BASE, Anchors, CoverTree, DualSearch, top_k


def brute(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, set()).add(tuple(math.floor(256 * x) for x in v))
    out = set()
    for q, vs in ok.items():
        if q % every:
            continue
        for v in vs:
            hits = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, ws in ok.items() if i != q for w in ws)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)}
    return out


def rows_of(n, dims, seed, copies=0.3):
    rng = random.Random(seed)
    hot = [rng.gauss(0, 0.3) for _ in range(dims)]
    out = []
    for i in range(n):
        v = list(hot) if rng.random() < copies else [rng.gauss(i % 7, 0.3) for _ in range(dims)]
        out.append((i, [float(np.float32(x)) for x in v]))
    return out


@pytest.mark.parametrize("cell,block,ask", [(4096, 8192, 32768), (60, 40, 3), (2, 7, 1)])
def test_like_brute_force(spark, cell, block, ask):
    rows = rows_of(500, 6, 1) + [(600, None), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (750, [float("inf")] * 6), (None, [1.0] * 6), (800, [0.0] * 6), (850, [0.5] * 3), (0, rows_of(1, 6, 1)[0][1])]
    rows += [(100, [float(j)] * 6) for j in range(12)]  # one id with many vectors
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, vid string").repartition(6)
    got = {tuple(r) for r in top_k(df, cell=cell, block=block, ask=ask).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)
    assert top_k(df.limit(0)).collect() == []
    assert top_k(df.filter("vec_id = 1")).collect() == []
    assert top_k(df.filter("vec_id = 50")).collect() == []


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [1e30, 1.0]), (1, [1.0, 0.0]), (2, [2.0, -1.0]), (3, [-1e30, 0.0]), (50, [4e15 / 256, 1.0]), (4, [3e15 / 256, 2.0]), (5, [3e15 / 256, 3.0]), (6, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df).collect()}
    top, least = (1 << 63) - 1, -(1 << 63)
    vecs = {i: [int(math.floor(min(256 * x, 1.7976931348623157e308))) for x in v] for i, v in rows}
    for q in (0, 50):
        want = sorted((-sum(a * b for a, b in zip(vecs[q], w, strict=True)), i) for i, w in vecs.items() if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, min(max(-s, least), top)) for s, i in want]


def test_cover_tree_covers_nests_and_separates():
    rng = np.random.default_rng(0)
    for p in (rng.integers(-200, 200, (700, 4)).astype(float), np.repeat(rng.integers(-9, 9, (90, 2)), 9, axis=0).astype(float), np.zeros((300, 2))):
        t = CoverTree(p)
        assert sorted(t.order.tolist()) == list(range(len(p)))
        points = p[t.order]
        for i, (s, e, parent, level, radius) in enumerate(t.nodes.tolist()):
            assert np.sqrt(((points[s:e] - points[s]) ** 2).sum(1)).max() <= radius + 1e-9 <= BASE**level + 1e-6 or radius == 0
            kids = t.children[i]
            if kids:
                assert sorted(t.span[k] for k in kids)[0][0] == s and sum(t.span[k][1] - t.span[k][0] for k in kids) == e - s
                centers = points[[t.span[k][0] for k in kids]]
                gaps = np.sqrt(((centers[:, None] - centers) ** 2).sum(2))
                assert (gaps + np.eye(len(kids)) * 1e9 > BASE ** (level - 1)).all()
        back = CoverTree.stored(t.nodes.tobytes(), points)
        assert back.children == t.children and back.span == t.span


def test_pruning():
    rng = np.random.default_rng(1)
    d = np.concatenate([rng.integers(-5, 5, (400, 3)) + 1000 * np.eye(3, dtype=int)[i % 3] for i in range(6)]).astype(float)
    q = d[:64] + 1
    tree, ids = CoverTree(d), np.arange(len(d))
    none = np.full(64, -math.inf)
    s = DualSearch(q, np.arange(64) + 10_000, 3, none)
    s.visit(tree, ids[tree.order])
    leaves = sum(not c for c in s.q.children) * sum(not c for c in tree.children)
    assert s.pairs < leaves
    big = DualSearch(q, np.arange(64) + 10_000, 3, none, exact=False)
    big.visit(tree, ids[tree.order])
    assert sorted(big.results()) == sorted(s.results())


def test_anchors_nest():
    p = np.random.default_rng(2).normal(size=(500, 3))
    a = Anchors(p, 60, level=10)
    assert len(a.top) == 7 and all((b[0] == t).all() for b, t in zip(a.below, a.top, strict=True))
    cells = a.assign(p)
    assert cells.min() >= 0 and cells.max() < a.first[-1] and len(set(cells.tolist())) > 30
