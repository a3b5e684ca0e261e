"""The lasso along a path: optimality, components, warm against cold starts, the distributed choice against a plain one."""

import numpy as np
import pytest

from graphduo.operators import estimate, lasso
from graphduo.sources import tables


def blocks(seed=0, n=30, sizes=(5, 3, 1, 4)):
    rng = np.random.default_rng(seed)
    p = sum(sizes)
    x, at = rng.normal(size=(n, p)), 0
    for k in sizes:
        x[:, at : at + k] += 1.5 * rng.normal(size=(n, 1))
        at += k
    return x[:, rng.permutation(p)]


def kkt(s, w, theta, alpha):
    """Largest violation of the optimality conditions."""
    off = ~np.eye(len(s), dtype=bool)
    gap = w - s
    on = off & (theta != 0)
    return max(np.abs(gap.diagonal()).max(), (np.abs(gap[off]) - alpha).max(initial=0), np.abs(gap[on] - alpha * np.sign(theta[on])).max(initial=0), np.abs(w @ theta - np.eye(len(s))).max())


def plain(s, alpha, rounds=4000):
    """Coordinate descent on the precision itself, one entry at a time, from the diagonal."""
    p = len(s)
    w, b = np.diag(s.diagonal()).astype(float), np.zeros((p, p))
    w = s.copy() * 0.9
    np.fill_diagonal(w, s.diagonal())
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = [k for k in range(p) if k != j]
            for _ in range(200):
                moved = 0.0
                for k in rest:
                    g = s[k, j] - sum(w[k, m] * b[j, m] for m in rest if m != k)
                    new = np.sign(g) * max(abs(g) - alpha, 0) / w[k, k]
                    moved, b[j, k] = max(moved, abs(new - b[j, k])), new
                if moved < 1e-13:
                    break
            for k in rest:
                w[k, j] = w[j, k] = sum(w[k, m] * b[j, m] for m in rest)
        if np.abs(w - before).max() < 1e-12:
            break
    return w, np.linalg.inv(w)


@pytest.mark.parametrize("n", [8, 60])
def test_every_step_of_the_path_is_optimal(n):
    s = np.cov(blocks(n=n).T, bias=True)
    alphas = [0.01, 2.0, 0.5, 0.1, 0.1, 0.03]
    got = {k: (w, t) for k, w, t in lasso.path(s, alphas, max_iter=500, tol=1e-12)}
    assert sorted(got) == list(range(6)) and np.allclose(got[3][1], got[4][1], atol=1e-8)
    for k, (w, theta) in got.items():
        assert kkt(s, w, theta, alphas[k]) < 1e-6
        cold = next(lasso.path(s, [alphas[k]], max_iter=500, tol=1e-12))[2]
        assert np.abs(cold - theta).max() < 1e-6 * max(1, np.abs(theta).max())


def test_against_plain_descent():
    s = np.cov(blocks(3, 40, (3, 2)).T, bias=True)
    for alpha in (0.05, 0.4):
        w, theta = estimate.graphical_lasso(s, alpha, tol=1e-12, max_iter=500)
        want, precision = plain(s, alpha)
        assert np.allclose(w, want, atol=1e-8) and np.allclose(theta, precision, atol=1e-6)


def test_default_tolerance_is_close_to_the_optimum():
    s = np.cov(blocks(5, 20, (6, 5, 4)).T, bias=True)
    for (_, _, a), (_, _, b) in zip(lasso.path(s, [0.5, 0.1, 0.02]), lasso.path(s, [0.5, 0.1, 0.02], max_iter=1000, tol=1e-13), strict=True):
        assert np.abs(a - b).max() < 1e-5 * np.abs(b).max()


def test_components_are_those_of_the_thresholded_covariance():
    s = np.cov(blocks(1).T, bias=True)
    found = lasso.Components(s)
    for alpha in (5.0, 1.0, 0.6, 0.3, 0.1, 0.0):
        reach = (np.abs(s) > alpha) | np.eye(len(s), dtype=bool)
        for _ in range(len(s)):
            reach = reach @ reach
        want = {tuple(np.flatnonzero(r).tolist()) for r in reach}
        assert {tuple(c.tolist()) for c in found.at(alpha)} == want


def test_rows_by_feature_signs_where_sets_do_not_settle():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = rng.normal(size=(6, 12))
        w, s = a.T @ a + 1e-3 * np.eye(12), rng.normal(size=12)
        free = np.arange(12) != 4
        for tries in (0, 12):
            b = lasso.row(w, s, 0.3, np.zeros(12), free, 1e-9, tries=tries)
            g = (s - w @ b)[free]
            assert b[4] == 0 and (np.abs(g) <= 0.3 + 1e-8).all() and np.allclose(g[b[free] != 0], 0.3 * np.sign(b[free][b[free] != 0]), atol=1e-8)


def test_no_penalty_one_column_and_constant_columns():
    x = blocks(4)
    s = np.cov(x.T, bias=True)
    assert np.allclose(estimate.graphical_lasso(s, 0)[1] @ s, np.eye(len(s)), atol=1e-6)
    assert estimate.graphical_lasso(np.array([[4.0]]), 0.1)[1].tolist() == [[0.25]]
    x[:, 3] = 1.0
    w, theta = estimate.graphical_lasso(np.cov(x.T, bias=True), 0.1)
    assert np.isfinite(theta).all() and np.abs(np.delete(theta[3], 3)).max() == 0


def test_choice_over_components_equals_that_over_windows(spark):
    x, y = np.vstack([blocks(k, 30) for k in range(4)]), np.vstack([blocks(10 + k, 30) for k in range(4)])
    alphas = [1.2, 0.9, 0.5, 0.25, 0.1, 0.05]
    chosen = set()
    for least in (alphas, alphas[:3]):  # one component in a window, and several
        for options in ({}, {"nonparanormal": True}, {"scale": "zscore"}):
            gs = estimate.estimate_graphs(tables.from_matrix(spark, x, y), 30, least, 0.1, **options).stored()
            got = {(r["graph_id"], r["src"], r["dst"]): r["weight"] for r in gs.edges.collect()}
            for sample, z in ((1, x), (2, y)):
                for win in range(4):
                    theta, _, k = estimate.fit_window(z[30 * win : 30 * win + 30], least, 0.1, options.get("nonparanormal", False), options.get("scale", False))
                    chosen.add(k)
                    for i, j in np.argwhere(np.triu(theta, 1) != 0):
                        assert got.pop((2 * win + sample - 1, int(i), int(j))) == pytest.approx(theta[i, j], rel=1e-5)
            assert not got and gs.sizes() == (4, 4) and gs.nodes.count() == 8 * 13
    assert len(chosen) > 1


def test_windows_fill_the_cores(spark):
    rng = np.random.default_rng(1)
    obs = tables.from_matrix(spark, rng.normal(size=(800, 3)), rng.normal(size=(800, 3)))
    n = estimate.tasks_for(spark, 160)
    assert n >= spark.sparkContext.defaultParallelism
    dealt = estimate.windows(obs, 10, n).groupBy("sample", "win").count()
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(1 for k in dealt.rdd.glom().map(len).collect() if k) >= spark.sparkContext.defaultParallelism


def test_a_wide_window_is_newton_steps_and_few(monkeypatch):
    """64 columns, 25 rows, 8 penalties: no descent over rows, which takes thousands of systems of equations, and the optimum all the same."""
    x = np.random.default_rng(3).normal(size=(25, 64)) / 8
    s, alphas = np.cov(x.T, bias=True), [float(a) for a in np.exp(np.linspace(-9, -6, 8))]
    calls, products = [], []
    monkeypatch.setattr(lasso, "row", lambda *a, **k: calls.append(1))
    conjugate = lasso.conjugate
    monkeypatch.setattr(lasso, "conjugate", lambda *a: products.append(1) or conjugate(*a))
    got = {k: (w, t) for k, w, t in lasso.path(s, alphas)}
    assert not calls and len(products) < 100
    assert max(kkt(s, w, t, alphas[k]) for k, (w, t) in got.items()) < 1e-9


def test_descent_over_rows_where_newton_steps_do_not_settle(monkeypatch):
    s = np.cov(blocks(6, 40).T, bias=True)
    alphas = [0.5, 0.1, 0.02]
    want = [(w, t) for _, w, t in lasso.path(s, alphas, tol=1e-12)]
    monkeypatch.setattr(lasso, "newton", lambda *a: None)
    for (w, t), (_, v, u) in zip(want, lasso.path(s, alphas, max_iter=500, tol=1e-12), strict=True):
        assert np.allclose(w, v, atol=1e-8) and np.allclose(t, u, atol=1e-6)
