import numpy as np
import pytest
from pyspark.sql import functions as F

from graphduo.operators import blocked, gram, mmd, wl
from graphduo.plans.lineage import cut
from graphduo.plans.two_sample import kernel_matrix, kernel_tiles, two_sample_test
from graphduo.sources.tables import gram_from_matrix

from .helpers import graph_set, random_set


@pytest.fixture(scope="module")
def far(spark):
    return graph_set(spark, random_set(spark, 12, seed=11, nodes=8, p=(0.2, 0.7))).with_degree_labels().stored()


def test_estimators_against_matrices(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 3))
    k = x @ x.T
    gs = graph_set(spark, [(1 + (i >= 3), ["a"], None, []) for i in range(7)])
    table, pooled = gram_from_matrix(spark, k), gs.pooled()
    a, b, c = k[:3, :3], k[3:, 3:], k[:3, 3:]
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    want = {"MMD_u": off(a) + off(b) - 2 * c.mean(), "MMD_b": a.mean() + b.mean() - 2 * c.mean()}
    for name, value in want.items():
        assert mmd.estimate(table, pooled, name).first()["statistic"] == pytest.approx(value)
        assert mmd.dense_stat(k, 3, name) == pytest.approx(value)
    odd = a.sum() / 9 + b.sum() / 12 - 2 * c.sum() / 16
    assert mmd.estimate(table, pooled, "MMD_b", compat=True).first()["statistic"] == pytest.approx(odd)
    with pytest.raises(ValueError):
        mmd.estimate(table, pooled, "MMD_l")
    with pytest.raises(ValueError):
        mmd.estimate(table.where("j < 5"), pooled, "MMD_u")


def test_linear_estimator_leaves_out_an_odd_last_graph(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 2))
    k = x @ x.T
    gs = graph_set(spark, [(1 + (i >= 3), ["a"], None, []) for i in range(6)])
    want = k[0, 1] + k[3, 4] - k[0, 4] - k[1, 3]
    assert mmd.estimate(gram_from_matrix(spark, k), gs.pooled(), "MMD_l").first()["statistic"] == pytest.approx(want)
    assert mmd.dense_stat(k, 3, "MMD_l") == pytest.approx(want)


def test_resamples_by_joins_equal_matrices(spark, far):
    table, pooled = wl.deep_wl(far, 1), far.pooled()
    k = gram.dense(table)
    deal = mmd.permutations(pooled, 3, 5).toPandas()
    null = {r["b"]: r["statistic"] for r in mmd.null_distribution(table, pooled, "MMD_u", 3, 5).collect()}
    for b, rows in deal.groupby("b"):
        order = [*rows[rows["a"] == 1]["ord"], *rows[rows["a"] == 2]["ord"]]
        assert sorted(order) == list(range(24))
        assert null[b] == pytest.approx(mmd.dense_stat(k[np.ix_(order, order)], 12, "MMD_u"))
    deal = mmd.bootstraps(pooled, 2, 5).toPandas()
    null = {r["b"]: r["statistic"] for r in mmd.null_distribution(table, pooled, "MMD_b", 2, 5, "bootstrap").collect()}
    for b, rows in deal.groupby("b"):
        order = list(rows.sort_values("slot")["ord"])
        assert null[b] == pytest.approx(mmd.dense_stat(k[np.ix_(order, order)], 12, "MMD_b"))


def test_power_and_shared_resamples(spark, far):
    out = {r["estimator"]: r for r in two_sample_test(far, "WWL", ["MMD_u", "MMD_b", "MMD_l", "MONK_EST"], B=200, Q=3, discount=1.0, h=1).collect()}
    assert all(out[e]["p_value"] < 0.05 for e in ("MMD_u", "MMD_b", "MONK_EST"))
    assert out["MMD_u"]["n1"] == out["MMD_u"]["n2"] == 12


def test_null_is_not_rejected(spark):
    gs = graph_set(spark, random_set(spark, 12, seed=13, nodes=6, p=(0.4, 0.4)))
    got = two_sample_test(gs, "DK", "MMD_u", B=300, type="wl", wl_it=1).first()
    assert got["p_value"] > 0.05


@pytest.mark.parametrize("scheme", ["permutation", "bootstrap"])
def test_nulls_by_tiles_and_one_by_one_agree(spark, far, scheme):
    table, pooled = wl.deep_wl(far, 1), far.pooled()
    k, ids = gram.dense(table), [r["graph_id"] for r in pooled.orderBy("ord").collect()]
    for name in ("MMD_u", "MMD_b", "MMD_l"):
        by = lambda df: np.array([r["statistic"] for r in df.orderBy("b").collect()])
        one = by(mmd.null_distribution(table, pooled, name, 40, 3, scheme))
        three = by(mmd.dense_null(spark, k, 12, {name: lambda m, n, rng, e=name: mmd.dense_stat(m, n, e)}, 40, 3, scheme, ids=ids))
        assert np.allclose(one, three) and one.std() > 0


def test_p_values_do_not_depend_on_the_kernels_scale(spark, far):
    k = gram.dense(wl.deep_wl(far, 1))
    for factor in (1.0, 1e-8, 1e8):
        got = {r["estimator"]: r["p_value"] for r in two_sample_test(None, factor * k, ["MMD_u", "MMD_b"], B=200, n1=12).collect()}
        first = got if factor == 1.0 else first
        assert got == first and got["MMD_u"] < 0.05
    null, seen = spark.createDataFrame([(1, 3e-12), (2, 1e-12), (3, 3e-12 * (1 - 1e-14)), (4, -5e-12)], "b int, statistic double"), spark.createDataFrame([(3e-12,)], "statistic double")
    assert mmd.p_value(null, seen).first()[0] == 0.5 == mmd.share_at_or_above(np.array([3e-12, 1e-12, 3e-12 * (1 - 1e-14), -5e-12]), 3e-12)


def test_kernels_by_name(spark, far):
    for kernel, o in (("RW_ARKU_plus", {"c": 1e-3, "r": 3}), ("RW_ARKU", {"c": 1e-3, "r": None, "normalize": True}), ("GNTK", {"num_layers": 2, "jk": True, "scale": "uniform"}), ("DK", {"type": "sp"}), ([{"name": "wl", "n_iter": 1}], {}), ("RW_ARKU_edge", {"c": 1e-3, "r": 2, "unique_edge_labels": ["a", "b"]}), ("RW_ARKL", {"c": 1e-3, "r": 2, "unique_node_labels": [str(d) for d in range(8)]})):
        assert gram.dense(kernel_matrix(far, kernel, **o)).shape == (24, 24)


def test_errors(spark, far):
    with pytest.raises(ValueError):
        two_sample_test(far, "no such", "MMD_u")
    with pytest.raises(ValueError):
        two_sample_test(far, "DK", "no such", type="wl")
    with pytest.raises(ValueError):
        two_sample_test(far, "DK", "MONK_EST", type="wl")
    with pytest.raises(ValueError):
        two_sample_test(far, "DK", "MONK_EST", type="wl", Q=4)
    with pytest.raises(KeyError):
        two_sample_test(far, "RW_ARKU_plus", "MMD_u", c=1e-3)
    with pytest.raises(ValueError):
        two_sample_test(far, "DK", "MMD_u", type="no")
    with pytest.raises(ValueError):
        graph_set(spark, [(1, ["a"], None, []), (2, ["a"], None, []), (2, ["a"], None, [])]).validate()


def test_precomputed_matrix_and_custom_parts(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(10, 2)), rng.normal(4, 1, size=(10, 2))])
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    got = two_sample_test(None, k, {"mine": lambda m, n, rng: float(m[:n, :n].mean() - m[:n, n:].mean())}, B=100, n1=10, bootstrap_method=lambda n, rng: rng.permutation(n), check_symmetry=True).first()
    assert got["estimator"] == "mine" and got["p_value"] < 0.05
    with pytest.raises(ValueError):
        two_sample_test(None, k + np.triu(np.ones((20, 20)), 1), "MMD_u", n1=None)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_statistics_that_are_rounding_tie(spark, scale):
    """A kernel that does not tell the graphs apart, but for its rounding: every resample is as far out as the samples."""
    noise = np.random.default_rng(3).normal(size=(20, 20)) * 1e-16
    k = scale * (0.3 + noise + noise.T + 0.7 * np.eye(20))
    assert [r["p_value"] for r in two_sample_test(None, k, ["MMD_u", "MMD_b", "MMD_l"], B=40, n1=10, seed=1).collect()] == [1.0] * 3
    gram, pooled = gram_from_matrix(spark, k), spark.range(20).selectExpr("id as graph_id", "if(id < 10, 1, 2) as sample", "int(id) as ord", "int(id % 10) as pos")
    seen = mmd.estimate(gram, pooled, "MMD_u")
    assert mmd.p_value(mmd.null_distribution(gram, pooled, "MMD_u", 40, 1), seen, mmd.largest_entry(gram)).first()[0] == 1.0


@pytest.mark.parametrize("kernel", ["RW_ARKU_plus", "RW_ARKU_edge"])
def test_walks_at_a_rank_are_tested_in_tiles(spark, monkeypatch, kernel):
    """No entry of the Gram matrix becomes a row, and the results are those of the table of rows."""
    gs = graph_set(spark, random_set(spark, n=9, weights=True)).stored()
    options = {"B": 50, "seed": 3, "c": 1e-2, "r": 3, "unique_edge_labels": None, "check_psd": False}
    k = cut(kernel_matrix(gs, kernel, **options))
    rows = two_sample_test(None, k, ["MMD_u", "MMD_b"], B=50, seed=3, n1=9)
    t = kernel_tiles(gs, kernel, **options)
    want, got = gram.dense(k), np.zeros((18, 18))
    for r in t.rows.collect():
        (a, b), (c, d) = t.span(r["p"]), t.span(r["q"])
        got[a:b, c:d] = np.frombuffer(r["tile"]).reshape(b - a, d - c)
    got = np.triu(got) + np.triu(got, 1).T
    assert np.abs(got - want).max() <= 1e-15 * np.abs(want).max() and blocked.largest(t) == np.abs(got).max()
    monkeypatch.setattr("graphduo.plans.two_sample.kernel_matrix", None)
    monkeypatch.setattr("graphduo.operators.blocked.tiles", None)
    seen = two_sample_test(gs, kernel, ["MMD_u", "MMD_b"], **options | {"check_psd": True})
    for x, y in zip(seen.collect(), rows.collect(), strict=True):
        assert x["statistic"] == pytest.approx(y["statistic"], rel=1e-9, abs=1e-15) and x["p_value"] == y["p_value"] and (x["n1"], x["n2"]) == (9, 9)


def test_graphs_are_dealt_to_the_cores_before_they_are_repeated(spark):
    pooled = cut(spark.range(40).select(F.col("id").alias("graph_id"), F.when(F.col("id") < 20, 1).otherwise(2).alias("sample"), F.col("id").cast("int").alias("ord")).coalesce(1))
    assert pooled.rdd.getNumPartitions() == 1 and mmd.over_cores(pooled).rdd.getNumPartitions() > 1
    got = {(r["b"], r["ord"]): r["a"] for r in mmd.permutations(pooled, 3, 7).collect()}
    for b in (1, 2, 3):
        first = set(mmd.hash_order(7, b, range(40))[:20].tolist())
        assert {k for k in range(40) if got[b, k] == 1} == first
    assert mmd.bootstraps(pooled, 3, 7).count() == 120
