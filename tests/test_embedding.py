from collections import Counter

import numpy as np
import pytest

from graphduo.operators import embedding, wl

from .helpers import graph_set, random_set


def sentences(spark, words):
    rows = [(g, f, n) for g, counted in enumerate(words) for f, n in counted.items()]
    return spark.createDataFrame(rows, "graph_id long, feature string, n long")


def near(words, window):
    """Pairs of a sentence written out, both ways."""
    out = Counter()
    for counted in words:
        s = [f for f in sorted(counted) for _ in range(counted[f])]
        for i in range(len(s)):
            for j in range(max(0, i - window), min(len(s), i + window + 1)):
                if i != j:
                    out[s[i], s[j]] += 1
    return out


def drawn(seed=0, graphs=12, features=14):
    rng = np.random.default_rng(seed)
    return [{f"f{k:02d}": int(rng.integers(1, 6)) for k in rng.choice(features, int(rng.integers(1, 9)), replace=False)} for _ in range(graphs)]


def information(met):
    names = sorted({a for a, _ in met})
    n = np.array([[met.get((a, b), 0) for b in names] for a in names], float)
    f = n.sum(axis=1)
    with np.errstate(divide="ignore"):
        return names, np.maximum(np.log(n * n.sum() / np.outer(f, f)), 0.0)


@pytest.mark.parametrize("window", [1, 2, 5])
def test_runs_meet_as_often_as_words_do(spark, window):
    words = drawn(window)
    got = {(r["feature"], r["context"]): r["n"] for r in embedding.cooccurrence(sentences(spark, words), window).collect()}
    assert got == dict(near(words, window))


def test_rare_features_are_left_out_before_windows_are_made(spark):
    words = [{"a": 1, "b": 1, "c": 1}, {"a": 1, "c": 1}]
    got = {(r["feature"], r["context"]): r["n"] for r in embedding.cooccurrence(sentences(spark, words), 1, 2).collect()}
    assert got == {("a", "c"): 2, ("c", "a"): 2}


def test_vectors_are_the_leading_eigenpairs_at_any_partitioning(spark):
    words = drawn(3, 20)
    names, m = information(near(words, 2))
    lam, u = np.linalg.eigh(m)
    best = np.argsort(-np.abs(lam))[:3]
    want = (u[:, best] * np.abs(lam[best])) @ u[:, best].T
    met = embedding.cooccurrence(sentences(spark, words), 2)
    runs = []
    for parts in (1, 7):
        v = {r["feature"]: r["v"] for r in embedding.vectors(met.repartition(parts), 3, spare=3, settled=1e-13).collect()}
        runs.append(np.array([v[n] for n in names]))
        assert np.allclose(runs[-1] @ runs[-1].T, want, atol=1e-6)
    assert np.allclose(runs[0], runs[1], atol=1e-6)


def test_blocks_are_cut_back_and_the_iteration_goes_on(spark):
    """Two blocks of four directions against 14 features: several restarts."""
    words = drawn(3, 20)
    names, m = information(near(words, 2))
    lam, u = np.linalg.eigh(m)
    best = np.argsort(-np.abs(lam))[:3]
    v = {r["feature"]: r["v"] for r in embedding.vectors(embedding.cooccurrence(sentences(spark, words), 2), 3, spare=1, depth=2, settled=1e-11).collect()}
    v = np.array([v[n] for n in names])
    assert np.allclose(v @ v.T, (u[:, best] * np.abs(lam[best])) @ u[:, best].T, atol=1e-3)


def test_more_dimensions_than_features_are_zeros(spark):
    v = embedding.vectors(embedding.cooccurrence(sentences(spark, [{"a": 2, "b": 1}, {"b": 1, "c": 2}]), 1), 5).collect()
    assert {r["feature"] for r in v} == {"a", "b", "c"} and all(len(r["v"]) == 5 and np.isfinite(r["v"]).all() for r in v)
    assert embedding.vectors(embedding.cooccurrence(sentences(spark, [{"a": 1}]), 1), 2).count() == 0


def test_kernel_on_vectors(spark):
    gs = graph_set(spark, random_set(spark, 4, seed=2)).stored()
    counted = {}
    for r in wl.counts(gs, "wl", 1).collect():
        counted.setdefault(r["graph_id"], {})[r["feature"]] = r["n"]
    names, m = information(near([counted[g] for g in sorted(counted)], 2))
    lam, u = np.linalg.eigh(m)
    best = np.argsort(-np.abs(lam))[:2]
    p = np.array([[counted[g].get(f, 0) / sum(counted[g].values()) for f in names] for g in sorted(counted)])
    want = p @ (u[:, best] * np.abs(lam[best])) @ u[:, best].T @ p.T
    got = {(r["i"], r["j"]): r["k"] for r in wl.deep_word2vec(gs, "wl", 1).collect()}
    assert all(abs(k - want[i, j]) < 1e-3 * np.abs(want).max() for (i, j), k in got.items())
