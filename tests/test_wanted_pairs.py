"""MMD_l by itself computes the kernel for the pairs of graphs that it reads."""

import numpy as np
import pytest

from graphduo.operators import gram, mmd
from graphduo.plans.two_sample import kernel_matrix, two_sample_test

from .helpers import graph_set, random_set

KERNELS = [
    ("DK", {"type": "wl", "wl_it": 1}), ("DK", {"type": "sp"}), ("WWL", {"discount": 1.0, "h": 1}), ("WWL", {"discount": 1.0, "h": 1, "sinkhorn": True}), ("GNTK", {"num_layers": 2, "jk": True, "scale": "uniform"}),
    ("RW_ARKU", {"c": 1e-2, "r": None}), ("RW_ARKU", {"c": 1e-2, "r": 3}), ("RW_ARKU_plus", {"c": 1e-2, "r": 3}), ([{"name": "pyramid_match"}], {}), ([{"name": "edge_histogram"}], {}),
]


@pytest.mark.parametrize(("kernel", "options"), KERNELS)
def test_only_wanted_pairs_are_computed(spark, kernel, options):
    from dataclasses import replace

    gs = graph_set(spark, random_set(spark, 4, seed=21, nodes=5)).stored()
    pairs = spark.createDataFrame([(0, 1), (2, 5), (3, 3), (0, 7), (6, 7)], "i int, j int")
    options = {"check_psd": False, **options}
    whole = gram.dense(kernel_matrix(gs, kernel, **options))
    got = {(r["i"], r["j"]): r["k"] for r in kernel_matrix(replace(gs, pairs=pairs), kernel, **options).collect()}
    assert set(got) == {(0, 1), (2, 5), (3, 3), (0, 7), (6, 7)}
    assert all(got[i, j] == pytest.approx(whole[i, j], abs=1e-12) for i, j in got)


@pytest.mark.parametrize("method", ["PermutationScheme", "BootstrapScheme"])
def test_the_test_is_that_on_the_whole_table(spark, method):
    gs = graph_set(spark, random_set(spark, 5, seed=22, nodes=5)).stored()
    alone = two_sample_test(gs, "DK", "MMD_l", B=15, seed=4, bootstrap_method=method, type="wl", wl_it=1).first()
    both = {r["estimator"]: r for r in two_sample_test(gs, "DK", ["MMD_u", "MMD_l"], B=15, seed=4, bootstrap_method=method, type="wl", wl_it=1).collect()}["MMD_l"]
    assert alone["statistic"] == pytest.approx(both["statistic"]) and alone["p_value"] == both["p_value"]
    near = mmd.wanted_pairs(gs.pooled(), 1, 4)
    assert near.count() <= 2 * 8 and np.all([r["i"] <= r["j"] for r in near.collect()])
