"""Rank-r walks on stored spectra against the inverse of every pair, at ranks below that of the graphs."""

import numpy as np
import pytest

from graphduo.operators import gram, walks

from .helpers import adjacency, graph_set, plain, random_set


def inverse(kind, x, y, c, r, labels, directed, mode="exclude"):
    """The published formulas, pair by pair."""
    n = [len(g[1]) for g in (x, y)]
    p = [np.full(k, 1 / k) for k in n]
    base = (p[0] @ p[0]) * (p[1] @ p[1])

    def top(a):
        lam, u = np.linalg.eigh(a)
        pick = np.argsort(-np.abs(lam), kind="stable")[:r]
        pick = pick[np.abs(lam[pick]) > 1e-12]
        return lam[pick], u[:, pick]

    def symmetric(a, b):
        (l1, u1), (l2, u2) = top(a), top(b)
        if not len(l1) or not len(l2):
            return 0.0
        mid = np.linalg.inv(np.diag(1 / np.kron(l1, l2)) - c * np.eye(len(l1) * len(l2)))
        q = np.kron(p[0] @ u1, p[1] @ u2)
        return c * q @ mid @ q

    if kind == "RW_ARKU_plus":
        return base + symmetric(adjacency(x), adjacency(y))
    if kind == "RW_ARKU_edge":
        keep = (lambda l: lambda e: e != l) if mode == "exclude" else (lambda l: lambda e: e == l)  # noqa: E741
        return base + sum(symmetric(adjacency(x, keep=keep(l)), adjacency(y, keep=keep(l))) for l in labels)  # noqa: E741
    parts = []
    for g, q in ((x, p[0]), (y, p[1])):
        a = adjacency(g, directed)
        if kind == "RW_ARKU":
            d = (a != 0).sum(axis=1) + (0 if directed else (np.diag(a) != 0))
            m, ends, mask = (a.T * np.where(d > 0, 1 / np.maximum(d, 1), 0)[:, None]), q[None, :], np.ones(len(q))
        else:
            one = np.array([[lab == l for lab in g[1]] for l in labels], float)  # noqa: E741
            m, ends, mask = a.T, one * q, one.sum(axis=0)
        u, w, vt = np.linalg.svd(m)
        keep = [k for k in range(min(r, len(w))) if w[k] > 1e-12]
        parts.append((ends @ u[:, keep], w[keep], ends @ vt[keep].T, vt[keep] @ (mask[:, None] * u[:, keep])))
    (l1, w1, r1, m1), (l2, w2, r2, m2) = parts
    if not len(w1) or not len(w2):
        return base
    mid = np.linalg.inv(np.diag(1 / np.kron(w1, w2)) - c * np.kron(m1, m2))
    return base + c * sum(np.kron(a, b) for a, b in zip(l1, l2, strict=True)) @ mid @ sum(np.kron(a, b) for a, b in zip(r1, r2, strict=True))


@pytest.mark.parametrize("kind", walks.KINDS)
@pytest.mark.parametrize("r", [1, 3])
def test_low_rank_equals_the_inverse_of_every_pair(spark, kind, r):
    directed = kind == "RW_ARKU"
    graphs = random_set(spark, 4, seed=11, nodes=7, weights=True, directed=directed)
    graphs += [(1, ["x"] * 3, None, []), (2, ["x", "y", "z", "x"], None, plain([(0, 1), (1, 2), (2, 3)]))]  # no edges; a path, which as a directed graph has a defective core
    if directed:
        graphs += [(2, list("xyzxy"), None, plain([(0, 1), (1, 2), (2, 0), (3, 4), (0, 3)])), (1, list("xyz"), None, plain([(0, 0), (0, 1), (1, 2)]))]
    gs = graph_set(spark, graphs, directed)
    order = sorted(range(len(graphs)), key=lambda k: (graphs[k][0], k))
    labels = {"RW_ARKU_edge": ["S", "a", "b"], "RW_ARKL": ["x", "y", "z"]}.get(kind)
    got = gram.dense(walks.spectral(gs, kind, 2e-2, r, labels=labels))
    for i, a in enumerate(order):
        for j, b in enumerate(order):
            assert got[i, j] == pytest.approx(inverse(kind, graphs[a], graphs[b], 2e-2, r, labels, directed), rel=1e-10, abs=1e-12)


def test_defective_cores_are_solved_as_they_are(spark):
    graphs = [(1, list("xyz"), None, plain([(0, 1), (1, 2)])), (1, list("xyzz"), None, plain([(0, 1), (1, 2), (2, 3), (0, 2)])), (2, list("xyz"), None, plain([(0, 1), (1, 2), (2, 0)])), (2, list("xy"), None, plain([(0, 1)]))]
    gs = graph_set(spark, graphs, True)
    assert [r["whole"] for r in walks.cores(gs, "RW_ARKU", 3).orderBy("ord").collect()].count(True) == 1
    got = gram.dense(walks.spectral(gs, "RW_ARKU", 0.3, 3))
    for i in range(4):
        for j in range(4):
            assert got[i, j] == pytest.approx(inverse("RW_ARKU", graphs[i], graphs[j], 0.3, 3, None, True), rel=1e-9)


def test_each_graph_is_decomposed_once_and_the_pair_step_is_native(spark):
    gs = graph_set(spark, random_set(spark, 5, seed=2))
    plan = walks.spectral(gs, "RW_ARKU_plus", 1e-2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_the_pair_grid_fills_the_cores(spark):
    rows = spark.range(40).selectExpr("cast(id as int) ord", "cast(id as double) v")
    n = spark.sparkContext.defaultParallelism
    for made in (gram.by_blocks(rows, lambda a, b: a["v"] * b["v"]), gram.native_blocks(rows, lambda a, b: gram.F.col(f"{a}v") * gram.F.col(f"{b}v"))):
        assert sum(1 for k in made.rdd.glom().map(len).collect() if k) >= n
        k = gram.dense(made)
        assert np.array_equal(k, np.outer(np.arange(40.0), np.arange(40.0)))
    assert gram.native_blocks(rows.limit(0), lambda a, b: gram.F.lit(0.0)).count() == 0
    assert np.array_equal(gram.dense(gram.by_blocks(rows, lambda xs, ys: np.outer([x["v"] for x in xs], [y["v"] for y in ys]), block=7, whole=True)), np.outer(np.arange(40.0), np.arange(40.0)))
