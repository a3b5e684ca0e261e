import itertools
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphduo.model import EDGES, GRAPHS, NODES, GraphSet
from graphduo.operators import external, gram, tangent, walks, wl

from .helpers import CYCLE5, K4, PATH3, STAR4, adjacency, graph_set, plain, random_set


def refined(g, h):
    labels = [list(g[1])]
    a = adjacency(g) != 0
    for _ in range(h):
        last = labels[-1]
        labels.append([(last[v], tuple(sorted(str(last[u]) for u in np.flatnonzero(a[v])))) for v in range(len(last))])
    return labels


def test_refinement_separates_and_keeps_isolated_nodes(spark):
    gs = graph_set(spark, [(1, ["a"] * 3, None, PATH3), (1, ["a"], None, []), (2, ["a"] * 4, None, STAR4), (2, ["a"] * 5, None, CYCLE5)])
    rows = wl.refinement(gs, 1).collect()
    kinds = {(r["graph_id"], r["node_id"]): r["label"] for r in rows if r["it"] == 1}
    assert kinds[0, 0] == kinds[0, 2] != kinds[0, 1]
    assert kinds[1, 0] not in {kinds[0, 0], kinds[0, 1]}
    assert kinds[2, 1] == kinds[0, 0] and kinds[3, 0] == kinds[0, 1]
    assert len(rows) == 2 * (3 + 1 + 4 + 5)


def test_label_kernels_against_dictionaries(spark):
    graphs = random_set(spark, 3, seed=1)
    gs = graph_set(spark, graphs)
    counts = [Counter((t, lab) for t, row in enumerate(refined(g, 2)) for lab in row) for g in graphs]
    n = len(graphs)
    vh = np.array([[sum(a[f] * b[f] for f in a) for b in counts] for a in counts])
    assert np.allclose(gram.dense(wl.vertex_histogram(gs, 2)), vh)
    size = np.array([sum(c.values()) for c in counts])
    assert np.allclose(gram.dense(wl.deep_wl(gs, 2)), vh / np.outer(size, size))
    assert gram.dense(gram.normalised(wl.deep_wl(gs, 2))).diagonal() == pytest.approx(np.ones(n))


def test_wasserstein_equals_the_best_assignment(spark):
    graphs = [(1, list("aab"), None, PATH3), (1, list("aba"), None, PATH3), (2, list("abb"), None, plain([(0, 1)])), (2, list("bbb"), None, plain([(0, 1), (1, 2), (0, 2)]))]
    gs = graph_set(spark, graphs)
    got = gram.dense(wl.wasserstein_distance(gs, 1))
    for i, j in itertools.combinations(range(4), 2):
        x, y = (list(zip(*refined(graphs[k], 1), strict=True)) for k in (i, j))
        cost = [[sum(map(lambda p, q: str(p) != str(q), a, b)) / 2 for b in y] for a in x]
        best = min(sum(cost[k][p[k]] for k in range(3)) / 3 for p in itertools.permutations(range(3)))
        assert got[i, j] == pytest.approx(best)
    assert gram.dense(wl.wasserstein(gs, 0.5, 1))[0, 2] == pytest.approx(math.exp(-0.5 * got[0, 2]))


def test_sinkhorn_comes_near_the_exact_cost(spark):
    gs = graph_set(spark, random_set(spark, 2, seed=2, nodes=4))
    near, exact = gram.dense(wl.sinkhorn_distance(gs, 1, 0.02)), gram.dense(wl.wasserstein_distance(gs, 1))
    assert np.abs(near - exact).max() < 0.05


def test_sinkhorn_equals_the_plain_loop_and_does_not_underflow(spark):
    graphs = random_set(spark, 3, seed=6, nodes=5) + [(1, ["x", "x", "y"], None, [])]
    gs = graph_set(spark, graphs)
    order = sorted(range(7), key=lambda k: (graphs[k][0], k))
    labels = {}
    for r in wl.refinement(gs, 2).collect():
        labels.setdefault(r["graph_id"], {}).setdefault(r["node_id"], {})[r["it"]] = r["label"]

    def plain(x, y, reg):
        c = np.array([[np.mean([x[a][t] != y[b][t] for t in range(3)]) for b in sorted(y)] for a in sorted(x)])
        k, u = np.exp(-c.astype(np.longdouble) / reg), np.ones(len(x), np.longdouble)  # of a range that holds exp(-10000)
        for _ in range(50):
            v = 1 / len(y) / (k.T @ u)
            u = 1 / len(x) / (k @ v)
        return (u[:, None] * k * v * c).sum()

    for reg in (0.5, 0.05, 1e-4):
        got = gram.dense(wl.sinkhorn_distance(gs, 2, reg))
        assert np.allclose(got, [[float(plain(labels[a], labels[b], reg) if i <= j else plain(labels[b], labels[a], reg)) for j, b in enumerate(order)] for i, a in enumerate(order)], atol=1e-9)
    assert np.exp(-1 / 1e-4) == 0


def test_shortest_paths(spark):
    gs = graph_set(spark, [(1, list("aba"), None, PATH3), (1, list("ab"), None, []), (2, list("aaaa"), None, K4), (2, ["b"], None, [])])
    f = {(r["graph_id"], r["feature"]): r["v"] for r in wl.shortest_path_features(gs).collect()}
    assert f[0, "a_b_1"] == pytest.approx(4 / 9) and f[0, "a_a_2"] == pytest.approx(2 / 9) and f[0, "a_a_0"] == pytest.approx(2 / 9)
    assert f[1, "a_a_0"] == f[1, "b_b_0"] == 0.5
    assert f[2, "a_a_1"] == pytest.approx(12 / 16)
    assert gram.dense(wl.deep_sp(gs)).shape == (4, 4)


@pytest.mark.parametrize("directed", [False, True])
def test_searches_over_several_words_of_sources(spark, directed):
    """Graphs of more than 64 nodes, ids that are negative or have gaps, loops, parts that do not meet, missing labels: against a search from every node."""
    rng = np.random.default_rng(4)
    graphs, nodes, edges = [(0, 1, directed), (1, 2, directed)], [], []
    want = {}
    for g, n in ((0, 150), (1, 70)):
        ids = [int(v) for v in rng.choice(np.arange(-200, 900), n, replace=False)]
        label = {v: [None, "a", "b", "c"][int(rng.integers(4))] for v in ids}
        arcs = {(ids[int(a)], ids[int(b)]) for a, b in rng.integers(0, n, (int(1.3 * n), 2))}
        nodes += [(g, v, label[v], None) for v in ids]
        edges += [(g, a, b, 1.0, "S") for a, b in arcs]
        out = {v: set() for v in ids}
        for a, b in arcs:
            out[a].add(b)
            if not directed:
                out[b].add(a)
        for s in ids:
            dist, front = {s: 0}, {s}
            while front:
                front = {b for a in front for b in out[a]} - dist.keys()
                dist |= dict.fromkeys(front, max(dist.values()) + 1)
            for b, d in dist.items():
                known = sorted(x for x in (label[s], label[b]) if x is not None)
                name = "_".join([*(known * 2 if len(known) == 1 else known), str(d)])
                want[g, name] = want.get((g, name), 0) + 1
    gs = GraphSet(spark.createDataFrame(graphs, GRAPHS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    assert {(r["graph_id"], r["feature"]): r["n"] for r in wl.shortest_path_counts(gs).collect()} == want
    with pytest.raises(RuntimeError):
        wl.shortest_path_counts(gs, 2)


def test_walk_series_is_rounded_about_once(spark):
    """Moments of whole weights by whole numbers: a pair adds up 8 x 8 products of labels for each length, and rounding at each of them would show."""
    rng, labels, c = np.random.default_rng(3), [str(v % 8) for v in range(16)], 2.0**-10
    sets = [(s, labels, None, [(a, b, float(rng.integers(1, 1000)), "S") for a, b in itertools.combinations(range(16), 2)]) for s in (1, 2) for _ in range(6)]
    walked = []
    for g in sets:
        a, m = adjacency(g).astype(int).astype(object), []
        v = np.array([[int(x == y) for y in "01234567"] for x in labels], dtype=object)
        ends = v.T
        for _ in range(2):
            v = a.dot(v)
            m.append(ends.dot(v).ravel())
        walked.append(m)
    off = []
    for r in walks.series(graph_set(spark, sets), "RW_ARKL", c, 2).collect():
        want = Fraction(1, 16**2) + sum(Fraction(c) ** k * int(x.dot(y)) / 16**4 for k, (x, y) in enumerate(zip(walked[r["i"]], walked[r["j"]]), 1))
        off.append(float((Fraction(r["k"]) - want) / want))
    assert len(off) == 78 and np.sqrt(np.mean(np.square(off))) < 2e-16


def test_steady_sum_does_not_depend_on_order_and_keeps_small_terms(spark):
    one = [1.0, 2.0**-53, 2.0**-53, 2.0**-53, 2.0**-53]
    for terms in (one, one[::-1]):
        got = spark.createDataFrame([(x,) for x in terms], "x double").coalesce(1).agg(gram.steady_sum(F.col("x"), F.lit(2.0)).alias("s")).first()["s"]
        assert got == 1.0 + 2.0**-51
    ends = spark.createDataFrame([(0.0, 0.0), (math.inf, math.inf), (math.nan, math.nan)], "x double, b double").groupBy("b").agg(gram.steady_sum(F.col("x"), F.col("b")).alias("s")).collect()
    assert sorted(str(r["s"]) for r in ends) == ["0.0", "inf", "nan"]


@pytest.mark.parametrize("kind", ["RW_ARKU_plus", "RW_ARKU", "RW_ARKU_edge", "RW_ARKL"])
def test_walk_series_equals_spectra_and_inverse(spark, kind):
    directed = kind == "RW_ARKU"
    graphs = random_set(spark, 2, seed=3, nodes=4, weights=kind != "RW_ARKL", directed=directed)
    gs = graph_set(spark, graphs, directed)
    c = 1e-2
    a, b = gram.dense(walks.series(gs, kind, c, 8)), gram.dense(walks.spectral(gs, kind, c, 4))
    assert np.allclose(a, b, atol=1e-7)
    if kind == "RW_ARKU_plus":
        x, y = adjacency(graphs[0]), adjacency(graphs[2])
        p = np.full(4, 0.25)
        whole = np.kron(p, p) @ np.linalg.inv(np.eye(16) - c * np.kron(x, y)) @ np.kron(p, p)
        assert a[0, 2] == pytest.approx(whole, abs=1e-9)


def test_walks_with_attributes_as_weights_and_errors(spark):
    gs = graph_set(spark, random_set(spark, 2, seed=4, nodes=3))
    a, b = gram.dense(walks.series(gs, "RW_ARKU", 1e-2, 8, use_attr=True)), gram.dense(walks.spectral(gs, "RW_ARKU", 1e-2, 3, use_attr=True))
    assert np.allclose(a, b, atol=1e-7)
    with pytest.raises(ValueError):
        walks.spectral(gs, "RW_ARKU_plus", 1e-2, 0)
    with pytest.raises(ValueError):
        walks.series(GraphSet(gs.graphs.selectExpr("graph_id", "sample", "true directed"), gs.nodes, gs.edges), "RW_ARKU_plus", 1e-2)
    with pytest.raises(ValueError, match="lower c"):
        gram.check_psd(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 1.0)], "i int, j int, k double"))


def test_edge_label_modes_differ_only_beyond_two_labels(spark):
    gs = graph_set(spark, random_set(spark, 2, seed=5, nodes=4))
    one, two = (gram.dense(walks.series(gs, "RW_ARKU_edge", 1e-2, 4, labels=["a", "b"], label_mode=m)) for m in ("exclude", "include"))
    assert np.allclose(one, two)


@pytest.mark.parametrize("scale", ["uniform", "degree"])
def test_tangent_kernel_by_joins_and_by_kronecker(spark, scale):
    graphs = random_set(spark, 2, seed=6, nodes=4, p=(0.5, 0.7))
    gs = graph_set(spark, graphs)
    a, b = gram.dense(tangent.two_layers(gs, 2, True, scale)), gram.dense(tangent.deep(gs, 2, 2, True, scale))
    assert np.allclose(a, b, rtol=1e-6)
    m = [(adjacency(g) != 0).astype(float) for g in graphs[:2]]
    big = [x + np.eye(4) for x in m]
    deg = [x.sum(axis=1) for x in m]

    def cov(x, y):
        s = (np.kron(big[x], big[y]) @ (deg[x][:, None] == deg[y][None, :]).astype(float).ravel()).reshape(4, 4)
        return s / np.outer(big[x].sum(1), big[y].sum(1)) if scale == "degree" else s

    s, d = cov(0, 1), [np.sqrt(np.diag(cov(k, k))) for k in (0, 1)]
    t, total = s.copy(), (deg[0][:, None] == deg[1][None, :]).sum()
    for _ in range(2):
        r = np.clip(s / np.outer(*d), -1, 1)
        s, slope = (r * (np.pi - np.arccos(r)) + np.sqrt(1 - r * r)) / np.pi * np.outer(*d), (np.pi - np.arccos(r)) / np.pi
        t = t * slope + s
    assert a[0, 1] == pytest.approx(2 * (total + t.sum()), rel=1e-9)


def test_tangent_kernel_of_one_edge_and_of_a_loop_by_hand(spark):
    edge = graph_set(spark, [(1, ["a", "a"], None, plain([(0, 1)])), (2, ["a", "a"], None, plain([(0, 1)]))])
    # one edge: A + A' + I is all ones, so every covariance is 4 = 2 * 2 and stays it (the correlation is 1, the slope 1):
    # t = 4, 8, 12; 4 node pairs of it, and the 4 raw products: 2 * (4 + 4 * 12)
    for k in (tangent.two_layers(edge), tangent.deep(edge, 2)):
        assert np.allclose(gram.dense(k), 104)
    rows = sorted(tuple(r) for r in tangent.neighbourhoods(edge).where("graph_id = 0").collect())
    assert rows == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1)]
    # a loop: A + A' + I is 3, a covariance 9 = 3 * 3: 2 * (1 + 27)
    loop = graph_set(spark, [(1, ["a"], None, plain([(0, 0)])), (2, ["a"], None, plain([(0, 0)]))])
    for k in (tangent.two_layers(loop), tangent.deep(loop, 2)):
        assert np.allclose(gram.dense(k), 56)


@pytest.mark.parametrize("directed", [False, True])
def test_tangent_kernel_of_deeper_networks_pair_by_pair(spark, directed):
    graphs = random_set(spark, 10, seed=10, nodes=5, p=(0.4, 0.7), directed=directed)
    gs = graph_set(spark, graphs, directed)
    got = gram.dense(tangent.deep(gs, 3, 2, True, "degree", use_attr=True))  # 20 graphs: two blocks
    m = [(adjacency(g, directed) != 0).astype(float) for g in graphs]
    big = [(x + x.T if directed else x) + np.eye(5) for x in m]
    feat = [np.array(g[2]) for g in graphs]

    def one(x, y, diag):
        mean = lambda s: big[x] @ s @ big[y].T / np.outer(big[x].sum(1), big[y].sum(1))
        s = mean(feat[x] @ feat[y].T)
        t, total, out, k = s.copy(), (feat[x] @ feat[y].T).sum(), [], 0
        for layer in range(2):
            for _ in range(2):
                d = (np.sqrt(np.diag(s)), np.sqrt(np.diag(s))) if diag is None else (diag[x][k], diag[y][k])
                out.append(d[0])
                k += 1
                r = np.clip(s / np.outer(*d), -1, 1)
                s, slope = (r * (np.pi - np.arccos(r)) + np.sqrt(1 - r * r)) / np.pi * np.outer(*d), (np.pi - np.arccos(r)) / np.pi
                t = t * slope + s
            total += t.sum()
            if layer == 0:
                s, t = mean(s), mean(t)
        return out if diag is None else 2 * total

    diag = [one(x, x, None) for x in range(20)]
    for x, y in ((0, 0), (0, 1), (3, 17), (16, 19), (19, 19)):
        assert got[x, y] == pytest.approx(one(x, y, diag), rel=1e-9)


def test_tangent_kernel_options(spark):
    gs = graph_set(spark, random_set(spark, 2, seed=7, nodes=3))
    a, b = gram.dense(tangent.two_layers(gs, 1, False, "uniform", use_attr=True)), gram.dense(tangent.deep(gs, 2, 1, False, "uniform", use_attr=True))
    assert np.allclose(a, b, rtol=1e-6)
    assert gram.dense(tangent.kernel(gs, 3)).shape == (4, 4)
    with pytest.raises(ValueError):
        tangent.two_layers(gs, scale="no")
    with pytest.raises(ValueError):
        tangent.kernel(gs, 2, degree_as_tag=False)


def test_invariance_to_renumbering_and_psd(spark):
    graphs = random_set(spark, 3, seed=8, nodes=5)
    perm = [3, 1, 4, 0, 2]
    moved = [(s, [lab[perm.index(v)] for v in range(5)], None, [(min(perm[a], perm[b]), max(perm[a], perm[b]), w, el) for a, b, w, el in e]) for s, lab, _, e in graphs]
    one, two = graph_set(spark, graphs), graph_set(spark, moved)
    for f in (lambda g: wl.deep_wl(g, 2), wl.deep_sp, lambda g: wl.wasserstein(g, 1.0, 2), lambda g: walks.series(g, "RW_ARKL", 1e-2, 4), lambda g: tangent.two_layers(g)):
        a, b = gram.dense(f(one)), gram.dense(f(two))
        assert np.allclose(a, b) and np.linalg.eigvalsh(a).min() > -1e-5


def test_other_kernels_are_symmetric_and_separate(spark):
    gs = graph_set(spark, random_set(spark, 3, seed=9, nodes=5, p=(0.2, 0.9)))
    for k in (external.propagation(gs, 2), external.propagation(gs, 1, 0.1, "L1", use_attr=True), external.pyramid_match(gs, 3, 3), wl.deep_word2vec(gs, "wl", 1, 2, 2, 0)):
        m = gram.dense(k)
        assert m.shape == (6, 6) and np.isfinite(m).all() and (m.diagonal() >= 0).all()
    assert gram.dense(external.by_name(gs, [{"name": "weisfeiler_lehman", "n_iter": 1}, {"name": "vertex_histogram"}])).shape == (6, 6)
    with pytest.raises(ValueError):
        external.by_name(gs, [{"name": "unknown"}])


def plain_pyramid(points, labels, levels):
    """points: one array (nodes, dims) a graph."""
    k = np.zeros((len(points), len(points)))
    for i, j in np.ndindex(k.shape):
        same = []
        for level in range(levels):
            n = 2**level
            one, two = (Counter((lab, d, min(int(x * n), n - 1)) for row, lab in zip(points[g], labels[g], strict=True) for d, x in enumerate(row)) for g in (i, j))
            same.append(sum((one & two).values()))
        k[i, j] = same[-1] + sum((same[t] - same[t + 1]) / 2 ** (levels - 1 - t) for t in range(levels - 1))
    return k


@pytest.mark.parametrize(("levels", "dims", "with_labels"), [(1, 2, True), (4, 3, True), (5, 7, False)])
def test_pyramid_match_equals_a_plain_loop(spark, levels, dims, with_labels):
    graphs = [*random_set(spark, 3, seed=4, nodes=6, weights=True), (2, ["x"], [[0.5, 0.5]], [])]
    gs = graph_set(spark, graphs)
    points = []
    for g in graphs:
        lam, u = np.linalg.eigh(adjacency(g))
        x = np.zeros((len(lam), dims))
        pick = np.argsort(-np.abs(lam), kind="stable")[:dims]
        x[:, : len(pick)] = np.abs(u[:, pick])
        points.append(x)
    labels = [g[1] if with_labels else [None] * len(g[1]) for g in graphs]
    assert np.allclose(gram.dense(external.pyramid_match(gs, levels, dims, with_labels)), plain_pyramid(points, labels, levels), rtol=0, atol=1e-12)
    held = [np.clip(np.array(g[2]), 0, 1) for g in graphs]
    assert np.allclose(gram.dense(external.pyramid_match(gs, levels, dims, with_labels, use_attr=True)), plain_pyramid(held, labels, levels), rtol=0, atol=1e-12)


def test_pyramid_match_of_nodes_without_labels_or_attributes(spark):
    gs = graph_set(spark, [(1, [None, "a"], [[0.2], [0.9]], PATH3[:1]), (2, [None, None], None, PATH3[:1])])
    assert gram.dense(external.pyramid_match(gs, 2, use_attr=True)).tolist() == [[2, 0], [0, 0]]
    assert gram.dense(external.pyramid_match(gs, 1, 1)).tolist() == [[2, 1], [1, 2]]


def test_symmetry_check(spark):
    k = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.5), (1, 1, 1.0)], "i int, j int, k double")
    assert gram.asymmetric(k).count() == 2
    assert gram.asymmetric(gram.symmetrised(k.where("i <= j"))).count() == 0
