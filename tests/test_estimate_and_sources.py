import numpy as np
import pytest

from graphduo.operators import estimate
from graphduo.sources import tables
from graphduo.streaming.windows import estimate_stream

from .conftest import SF
from .helpers import CYCLE5, PATH3, graph_set, random_set


def correlated(n, p=5, seed=0):
    rng = np.random.default_rng(seed)
    theta = np.eye(p) * 2
    for k in range(p - 1):
        theta[k, k + 1] = theta[k + 1, k] = 0.8
    return rng.multivariate_normal(np.zeros(p), np.linalg.inv(theta), n)


def test_lasso_meets_the_optimality_conditions():
    s = np.cov(correlated(400).T, bias=True)
    alpha = 0.05
    w, theta = estimate.graphical_lasso(s, alpha, tol=1e-9)
    assert np.allclose(w @ theta, np.eye(5), atol=1e-3)
    gap, off = w - s, ~np.eye(5, dtype=bool)
    assert np.allclose(gap.diagonal(), 0, atol=1e-9) and (np.abs(gap[off]) <= alpha + 1e-4).all()
    on = off & (np.abs(theta) > 1e-6)
    assert np.allclose(gap[on], alpha * np.sign(theta[on]), atol=1e-3)


def test_two_columns_in_closed_form(spark):
    x = correlated(60, 2, seed=4)
    obs = tables.from_matrix(spark, x[:40], x[20:])
    got = {(r["sample"], r["win"]): r["weight"] for r in estimate.two_column_precision(obs, 20, 0.05).collect()}
    assert len(got) == 4
    for s, part in ((1, x[:40]), (2, x[20:])):
        for w in range(2):
            _, theta = estimate.graphical_lasso(np.cov(part[20 * w : 20 * w + 20].T, bias=True), 0.05, tol=1e-12)
            assert got[s, w] == pytest.approx(theta[0, 1], abs=1e-6)


def test_ranks_and_scores(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [2.0, 1.0], [7.0, 0.0]])
    v = estimate.long_form(estimate.windows(tables.from_matrix(spark, x, x), 4))
    ranks = {(r["row_idx"], r["col"]): r["r"] for r in estimate.average_ranks(v.where("sample = 1")).collect()}
    assert [ranks[i, 0] for i in range(4)] == [1, 2.5, 2.5, 4] and [ranks[i, 1] for i in range(4)] == [3.5, 3.5, 2, 1]
    got = {(r["row_idx"], r["col"]): r["x"] for r in estimate.nonparanormal(v.where("sample = 2")).collect()}
    want = estimate.gaussian_scores(x)
    assert all(got[i, c] == pytest.approx(want[i, c]) for i in range(4) for c in range(2))


def test_windows_drop_the_rest(spark):
    x = correlated(25)
    w = estimate.windows(tables.from_matrix(spark, x, x[:9]), 10)
    assert {(r["sample"], r["win"]) for r in w.select("sample", "win").distinct().collect()} == {(1, 0), (1, 1)}


def test_graphs_from_windows_with_labels_and_attributes(spark):
    x, y = correlated(200, seed=1), correlated(200, seed=2)
    obs = tables.from_matrix(spark, x, y)
    gs = estimate.estimate_graphs(obs, 100, [0.02, 0.1, 5.0], 0.5, set_labels="degree", set_attributes=lambda m: m.mean(axis=0)[:, None]).stored()
    assert gs.sizes() == (2, 2) and gs.nodes.count() == 20
    chain = gs.edges.where("dst = src + 1").groupBy("graph_id").count().collect()
    assert len(chain) == 4 and all(r["count"] >= 3 for r in chain)
    deg = {(r["graph_id"], r["node_id"]): r["label"] for r in gs.nodes.collect()}
    assert set(deg.values()) <= set("01234")
    again = estimate.estimate_graphs(obs, 100, 0.05, 0.5, nonparanormal=True, scale="zscore", set_labels=lambda m: {k: str(round(m[:, k].mean(), 1)) for k in range(5)})
    assert again.nodes.where("label is null").count() == 0
    named = estimate.estimate_graphs(obs, 100, 0.05, 0.5, set_labels={"1": dict.fromkeys(range(5), "a"), "2": dict.fromkeys(range(5), "b")})
    assert {r[0] for r in named.nodes.select("label").distinct().collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        estimate.estimate_graphs(obs, 100, 0.05, 1.5)
    with pytest.raises(ValueError):
        estimate.estimate_graphs(obs, 100, 0.05, 0.5, set_labels="other")


def test_ebic_counts_and_singular_covariances():
    x = correlated(50, 3)
    cov = np.cov(x.T, bias=True)
    theta = np.linalg.inv(cov)
    full = estimate.ebic(x, x.mean(0), cov, theta, 0.5)
    assert full == pytest.approx(-2 * estimate.log_likelihood(x, x.mean(0), cov) + np.log(50) * 6 + 4 * 6 * 0.5 * np.log(3))
    z = np.column_stack([x, x[:, 0]])
    assert np.isfinite(estimate.log_likelihood(z, z.mean(0), np.cov(z.T, bias=True)))


def test_self_loops_and_degrees(spark):
    gs = graph_set(spark, [(1, ["a", "b"], None, [(0, 0, 1.0, "S"), (0, 1, 1.0, "S")])])
    assert gs.arcs().count() == 3
    assert {r["node_id"]: r["degree"] for r in gs.degrees().collect()} == {0: 3, 1: 1}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, tmp_path, fmt):
    gs = graph_set(spark, [(1, list("abc"), [[0.5], [1.0], [2.0]], PATH3), (2, list("abcde"), None, CYCLE5)])
    tables.write(gs, str(tmp_path), fmt)
    back = tables.read(spark, str(tmp_path), fmt)
    for a, b in ((gs.graphs, back.graphs), (gs.edges, back.edges), (gs.nodes.where("graph_id = 0"), back.nodes.where("graph_id = 0"))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path), "xml")


class Toy:
    def __init__(self, nodes, edges, directed=False):
        self._n, self._e, self._d = nodes, edges, directed

    def nodes(self, data=True):
        return list(self._n.items())

    def edges(self, data=True):
        return [(a, b, d) for (a, b), d in self._e.items()]

    def is_directed(self):
        return self._d


def test_graph_objects(spark):
    g = Toy({"x": {"label": 1, "attr": [1.0]}, "y": {"label": 2, "attr": 2.0}}, {("y", "x"): {"w": 0.5, "kind": "a"}})
    gs = tables.from_objects(spark, [g, g], [g, g], "label", "attr", "w", "kind")
    assert gs.sizes() == (2, 2)
    e = gs.edges.first()
    assert (e["src"], e["dst"], e["weight"], e["edge_label"]) == (0, 1, 0.5, "a")
    assert [r["label"] for r in gs.nodes.where("graph_id = 0").orderBy("node_id").collect()] == ["1", "2"]


def test_a_stream_gives_the_batch_windows(spark, tmp_path):
    x = correlated(60, 3, seed=5)
    obs = tables.from_matrix(spark, x, x[::-1].copy())
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    out = estimate_stream(spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 20, 0.02, 0.5)
    q = out.writeStream.format("memory").queryName("edges_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["sample"], r["win"], r["src"], r["dst"]): round(r["weight"], 9) for r in spark.table("edges_out").collect()}
    want = {}
    for s, m in ((1, x), (2, x[::-1])):
        for w in range(3):
            theta, _, _ = estimate.fit_window(m[20 * w : 20 * w + 20], [0.02], 0.5)
            want |= {(s, w, int(i), int(j)): round(float(theta[i, j]), 9) for i, j in np.argwhere(np.triu(theta, 1) != 0)}
    assert got == want


def test_missing_labels_are_reported(spark):
    gs = graph_set(spark, random_set(spark, 2, seed=1))
    with pytest.raises(ValueError):
        type(gs)(gs.graphs, gs.nodes.selectExpr("graph_id", "node_id", "cast(null as string) label", "attr"), gs.edges).validate(label=True)


def test_queries_read_every_column(spark, tmp_path):
    from graphduo import catalog

    x = 0.15 * np.concatenate([correlated(50, 9), correlated(50, 9, 1)]).astype(np.float32)
    spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(float)
    scores, graphs = {}, {}
    for r in catalog.QUERIES["matrix_nonparanormal"](spark, str(tmp_path)).collect():
        scores[r["row_idx"], r["col"]] = r["x_micro"] / 1e6
    for r in catalog.QUERIES["matrix_graphs"](spark, str(tmp_path)).collect():
        graphs.setdefault(r["graph_id"], {})[r["src"], r["dst"]] = r["weight"]
    want = np.concatenate([estimate.gaussian_scores(x[k : k + 25]) for k in range(0, 100, 25)])
    assert np.allclose([[scores[i, j] for j in range(9)] for i in range(100)], want, atol=1e-6)
    for k in range(4):
        theta = estimate.fit_window(x[25 * k : 25 * k + 25], [float(a) for a in np.exp(np.linspace(-9, -6, 8))], 0.0, True)[0]
        got = graphs[2 * k + k % 2]  # graph_id = 2 win + sample - 1
        assert got == {(int(i), int(j)): pytest.approx(theta[i, j], rel=1e-6) for i, j in np.argwhere(np.triu(theta, 1) != 0)} and max(j for _, j in got) == 8


def test_items_are_dealt_by_number(spark, monkeypatch):
    """Where a core has more items than ITEMS, joins are of that many tasks and broadcast nothing; the graphs stay the same."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    few = tables.co_purchase(spark, SF)
    assert tables.item_tasks(lines) == 0
    monkeypatch.setattr(tables, "ITEMS", lines.count() // 9)
    many = tables.co_purchase(spark, SF)
    assert tables.item_tasks(lines) in (9, 10)
    plan = many.edges._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey#" in plan and f", {tables.item_tasks(lines)})" in plan and "REPARTITION_BY_NUM" in plan
    for a, b in ((few.edges, many.edges), (few.graphs, many.graphs), (few.nodes.drop("attr"), many.nodes.drop("attr"))):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_items_meet_their_orders_in_one_shuffle(spark, monkeypatch):
    """Tasks are no fewer than the session's shuffle partitions: fewer would be dealt once more before the join. No row is kept for a pair of an order."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    monkeypatch.setattr(tables, "ITEMS", lines.count() // 9)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert tables.item_tasks(lines) == 24
        edges = tables.co_purchase(spark, SF).edges
        edges.collect()
        plan = edges._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plan.count("Exchange hashpartitioning(l_orderkey#") == 1
    assert not [x for x in plan.splitlines() if " HashAggregate(" in x and "l_orderkey#" in x]


def test_pairs_of_an_order_count_once(spark, tmp_path):
    """Against a plain loop: brands held several times in an order, alike or not, flags and brands that are null."""
    rng = np.random.default_rng(3)
    brand = [None, *[f"Brand#{k}" for k in range(1, 6)]]
    part = [(k, brand[k % 6]) for k in range(24)]
    orders = [(k, int(rng.integers(6)), f"{rng.integers(1, 3)}-X") for k in range(60)]
    lines = [(int(rng.integers(60)), int(rng.integers(24)), [None, "A", "N", "R"][rng.integers(4)], float(rng.integers(10)) / 100) for _ in range(400)]
    for name, rows, ddl in (("part", part, "p_partkey long, p_brand string"), ("orders", orders, "o_orderkey long, o_custkey long, o_orderpriority string"), ("customer", [(k, k % 2) for k in range(6)], "c_custkey long, c_nationkey int"), ("lineitem", lines, "l_orderkey long, l_partkey long, l_returnflag string, l_discount double")):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    baskets, counted = {}, {}
    for o, p, flag, _ in lines:
        baskets.setdefault((orders[o][1] % 2 * 10 + int(orders[o][2][0]), o), set()).add((part[p][1], flag))
    for (g, _), b in baskets.items():
        of = {}
        for x, flag in b:
            of.setdefault(x, set()).add(flag)
        for x in of:
            for y in of:
                if x and y and x < y:
                    counted.setdefault((g, x, y), []).append(bool((of[x] & of[y]) - {None}))
    means = {g: np.mean([len(v) for (h, _, _), v in counted.items() if h == g]) for g, _, _ in counted}
    want = {(*k, float(len(v)), "S" if any(v) else "D") for k, v in counted.items() if len(v) > means[k[0]]}
    gs = tables.co_purchase(spark, str(tmp_path))
    label = {(r["graph_id"], r["node_id"]): r["label"] for r in gs.nodes.collect()}
    got = [(r["graph_id"], label[r["graph_id"], r["src"]], label[r["graph_id"], r["dst"]], r["weight"], r["edge_label"]) for r in gs.edges.collect()]
    assert set(got) == want and len(got) == len(want) > 0
