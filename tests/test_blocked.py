"""The Gram table in tiles: products, eigenvalues, factors and resamples against dense matrices."""

import numpy as np
import pytest

from graphduo.operators import blocked, gram, mmd
from graphduo.plans.two_sample import two_sample_test
from graphduo.sources.tables import gram_from_matrix


def symmetric(n, seed=0, rank=None, negative=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank or n))
    k = x @ x.T
    for _ in range(negative):
        v = rng.normal(size=n)
        k -= 0.3 * np.outer(v, v)
    return k


@pytest.mark.parametrize("edge", [1, 4, 100, None])
def test_products(spark, edge):
    k = symmetric(13)
    t = blocked.tiles(gram_from_matrix(spark, k), 13, edge)
    v = np.random.default_rng(1).normal(size=(13, 3))
    assert np.allclose(blocked.times(t, v), k @ v)


def test_least_eigenvalue(spark):
    for k in (symmetric(20), symmetric(20, 1, 4), symmetric(30, 2, 5, 3), np.eye(6), np.zeros((4, 4)), np.diag([1.0, -2e-11, 3.0])):
        t = blocked.tiles(gram_from_matrix(spark, k), len(k))
        for width in (3, 64):
            assert blocked.least_eigenvalue(t, width=width) == pytest.approx(np.linalg.eigvalsh(k)[0], abs=1e-9)


def test_the_check_never_collects_the_table(spark, monkeypatch):
    monkeypatch.setattr(gram, "dense", lambda k: pytest.fail("the whole matrix"))
    good, bad = gram_from_matrix(spark, symmetric(20, 1, 4)), gram_from_matrix(spark, symmetric(20, 2, 4, 1))
    assert gram.check_psd(good.selectExpr("i", "j", "k + if(i = j, 1e-9, 0.0) as k")).count() == 210
    with pytest.raises(ValueError, match="lower c"):
        gram.check_psd(bad)
    assert gram.check_psd(good.limit(0)).count() == 0
    two_sample_test(None, symmetric(12, 3), ["MMD_u", "MMD_b", "MMD_l", "MONK_EST"], B=20, Q=3, n1=6).collect()


@pytest.mark.parametrize("negative", [0, 3])
def test_factor_of_an_indefinite_matrix(spark, negative):
    k = symmetric(24, 5, 6, negative)
    f = blocked.factor(blocked.tiles(gram_from_matrix(spark, k), 24, 5), width=4)
    lam, u = np.linalg.eigh(k)
    assert f.basis.shape[1] <= 6 + negative + 4 and np.allclose(f.basis @ f.core @ f.basis.T, k, atol=1e-8)
    assert np.allclose(f.plus @ f.plus.T, (u * np.maximum(lam, 0)) @ u.T, atol=1e-8)


def published(k, n1, q, rng, rounds=100, beta=0.001):
    """The robust estimate with the repaired Cholesky factor, entry by entry on the whole matrix."""
    n = len(k)
    lam, u = np.linalg.eigh(k)
    root = np.linalg.qr((u * np.sqrt(np.where(lam <= 0, 0, lam))).T)[1]
    c = np.ones(n) / np.sqrt(np.ones(n) @ k @ np.ones(n))
    for t in range(rounds):
        one = np.array_split(rng.permutation(n1), q)
        two = one if 2 * n1 == n else np.array_split(rng.permutation(n - n1), q)
        gaps = np.array([k[a].mean(axis=0) @ c - k[b + n1].mean(axis=0) @ c for a, b in zip(one, two, strict=True)])
        mid = np.argsort(gaps)[q // 2]
        step = np.zeros(n)
        step[one[mid]], step[two[mid] + n1] = 1, -1
        c = c + (step / np.linalg.norm(root @ step) - c) / (1 + beta * t)
    return gaps[mid]


@pytest.mark.parametrize("n1", [10, 8])
def test_median_of_means_on_an_indefinite_matrix(spark, n1):
    k = symmetric(20, 7, 8, 2) + 3.0
    want = published(k, n1, 3, np.random.default_rng([5, 0]))
    assert mmd.median_of_means(k, n1, 3, np.random.default_rng([5, 0])) == pytest.approx(want)
    got = two_sample_test(None, k, "MONK_EST", B=30, Q=3, n1=n1, seed=5).first()
    null = [published(k[np.ix_(o, o)], n1, 3, np.random.default_rng([5, b])) for b in range(1, 31) for o in [mmd.hash_order(5, b, range(20))]]
    assert got["statistic"] == pytest.approx(want) and got["p_value"] == pytest.approx(np.mean(np.array(null) >= want - 1e-9))


def test_own_functions_are_told_the_bound(spark, monkeypatch):
    monkeypatch.setattr(mmd, "WHOLE", 5)
    with pytest.raises(ValueError, match="at most 5"):
        two_sample_test(None, symmetric(8), {"mine": lambda m, n, rng: 0.0}, B=5, n1=4)


def test_rounding_of_large_entries_is_no_negative_eigenvalue(spark):
    k = 1e12 * symmetric(24, 6, 3)
    assert np.linalg.eigvalsh(k)[0] < -1e-11
    assert gram.check_psd(gram_from_matrix(spark, k)).count() == 300
    with pytest.raises(ValueError, match="positive semidefinite"):
        gram.check_psd(gram_from_matrix(spark, k - 1e6 * np.eye(24)))
