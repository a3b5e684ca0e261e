"""Graph neural tangent kernel (Du et al. 2019): matrix products in blocks of graph pairs, and the same by joins for two layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NEAR, arc_cosine
from ..model import GraphSet
from . import gram, walks


def node_features(gs: GraphSet, degree_as_tag: bool, use_attr: bool) -> DataFrame:
    """(graph_id, node_id, dim, v), sparse: the attribute if asked for, else the degree as a one-hot."""
    if use_attr:
        if gs.nodes.where("attr is null").limit(1).count():
            raise ValueError("this kernel needs an attribute on every node")
        return gs.nodes.select("graph_id", "node_id", F.posexplode("attr").alias("dim", "v")).withColumn("dim", F.col("dim").cast("long"))
    if not degree_as_tag:
        raise ValueError("give node attributes or degree_as_tag")
    return gs.degrees().select("graph_id", "node_id", F.col("degree").cast("long").alias("dim"), F.lit(1.0).alias("v"))


def neighbourhoods(gs: GraphSet) -> DataFrame:
    """(graph_id, node_id, other): the rows of A + A' + I, A holding each edge once; edge weights do not count.

    A neighbour counts once where edges have no direction, twice where arcs go both ways; a node
    counts once for itself and twice more for a self-loop.
    """
    e = gs.edges.select("graph_id", "src", "dst").distinct()
    there = e.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("other"))
    back = e.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("other"))
    return there.unionAll(back).unionAll(gs.nodes.select("graph_id", "node_id", F.col("node_id").alias("other")))


def two_layers(gs: GraphSet, num_mlp_layers: int = 2, jk: bool = True, scale: str = "uniform", degree_as_tag: bool = True, use_attr: bool = False) -> DataFrame:
    """Depth two by joins: the first aggregation is bilinear, so a covariance is the dot product of neighbourhood sums h, and the diagonal is |h|^2 at every step."""
    if scale not in ("uniform", "degree"):
        raise ValueError("scale must be 'uniform' or 'degree'")
    f, nb = node_features(gs, degree_as_tag, use_attr), neighbourhoods(gs)
    size = nb.groupBy("graph_id", "node_id").agg(F.count("*").alias("m"))
    h = nb.join(f.select("graph_id", F.col("node_id").alias("other"), "dim", "v"), ["graph_id", "other"]).groupBy("graph_id", "node_id", "dim").agg(F.sum("v").alias("v"))
    if scale == "degree":
        h = h.join(size, ["graph_id", "node_id"]).withColumn("v", F.col("v") / F.col("m")).drop("m")
    pooled = gs.pooled()
    at = pooled.select("graph_id", "ord")
    h = h.join(at, "graph_id").select("ord", "node_id", "dim", "v")
    diag = h.groupBy("ord", "node_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("d"))
    a = h.select(F.col("ord").alias("i"), F.col("node_id").alias("u"), "dim", F.col("v").alias("a"))
    b = h.select(F.col("ord").alias("j"), F.col("node_id").alias("w"), "dim", F.col("v").alias("b"))
    s = a.join(b, "dim").where("i <= j").groupBy("i", "j", "u", "w").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    # node pairs without a common feature have covariance 0, whose step is not 0: they need a row too
    nodes = diag.select("ord", "node_id", "d")
    left, right = nodes.select(F.col("ord").alias("i"), F.col("node_id").alias("u"), F.col("d").alias("d1")), nodes.select(F.col("ord").alias("j"), F.col("node_id").alias("w"), F.col("d").alias("d2"))
    grid = gram.all_pairs(pooled).join(left, "i").join(right, "j")
    now = grid.join(s, ["i", "j", "u", "w"], "left").withColumn("s", F.coalesce("s", F.lit(0.0))).withColumn("t", F.col("s"))
    for _ in range(num_mlp_layers):
        new, slope = arc_cosine(F.col("s"), F.col("d1"), F.col("d2"))
        now = now.withColumns({"n": new, "ds": slope}).withColumn("t", F.col("t") * F.col("ds") + F.col("n")).withColumn("s", F.col("n")).drop("n", "ds")
    k = now.groupBy("i", "j").agg(F.sum("t").alias("t"))
    if jk:
        total = f.join(at, "graph_id").groupBy("ord", "dim").agg(F.sum("v").alias("v"))
        raw = total.select(F.col("ord").alias("i"), "dim", F.col("v").alias("a")).join(total.select(F.col("ord").alias("j"), "dim", F.col("v").alias("b")), "dim").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("raw"))
        k = k.join(raw, ["i", "j"], "left").withColumn("t", F.col("t") + F.coalesce("raw", F.lit(0.0)))
    return k.select("i", "j", (2 * F.col("t")).alias("k"))


def arc_step(s: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arc-cosine step of covariances s with standard deviations d1, d2: new covariances and their slopes; 0 where a deviation is 0."""
    grid = np.outer(d1, d2)
    ok = grid > 0
    r = np.divide(s, grid, out=np.zeros_like(s), where=ok)
    r = np.where(np.abs(r) > 1 - NEAR, np.sign(r), r)
    rest = np.pi - np.arccos(r)
    return np.where(ok, (r * rest + np.sqrt(1 - r * r)) / np.pi * grid, 0.0), np.where(ok, rest / np.pi, 0.0)


def deep(gs: GraphSet, num_layers: int, num_mlp_layers: int | None = None, jk: bool = True, scale: str = "uniform", degree_as_tag: bool = True, use_attr: bool = False) -> DataFrame:
    """Any depth, a block of graph pairs at a time: with the graphs of a block as one graph of several parts, neighbour sums are A S B on the
    matrix of all their node pairs, and a kernel value is the sum over its part; never a Kronecker product."""
    if scale not in ("uniform", "degree"):
        raise ValueError("scale must be 'uniform' or 'degree'")
    if not use_attr and not degree_as_tag:
        raise ValueError("give node attributes or degree_as_tag")
    if use_attr and gs.nodes.where("attr is null").limit(1).count():
        raise ValueError("this kernel needs an attribute on every node")
    mlps = num_layers if num_mlp_layers is None else num_mlp_layers
    gs_rows = walks.graph_rows(gs)

    def gather(s, x, y):
        return np.outer(x["scale"], y["scale"]) * (x["a"] @ s @ y["a"].T)

    def product(x, y):
        return x["f"] @ y["f"].T if use_attr else (x["f"][:, None] == y["f"][None, :]).astype(float)

    def prep(row):
        m = (walks.adjacency({**row, "arcs": [{**dict(e if isinstance(e, dict) else e.asDict()), "weight": 1.0} for e in (row["arcs"] if row["arcs"] is not None else ())]}) != 0).astype(float)
        loops = np.diag(np.diag(m))
        x = {"a": (m + m.T if row["directed"] else m + loops) + np.eye(len(m))}
        x["scale"] = 1 / x["a"].sum(axis=1) if scale == "degree" else np.ones(len(m))
        deg = m.sum(axis=1) + (m.sum(axis=0) if row["directed"] else np.diag(m))
        x["f"] = np.array([list(v["attr"]) for v in row["nodes"]]) if use_attr else deg
        # standard deviations of every step, from the graph against itself
        s, x["diag"] = gather(product(x, x), x, x), []
        for layer in range(1, num_layers):
            for _ in range(mlps):
                d = np.sqrt(np.maximum(np.diag(s), 0))
                x["diag"].append(d)
                s = arc_step(s, d, d)[0]
            if layer < num_layers - 1:
                s = gather(s, x, x)
        return x

    def together(xs):
        """Several graphs as one: their neighbourhoods as blocks of a matrix, the other arrays in a row."""
        n = [len(x["scale"]) for x in xs]
        out = {"a": np.zeros((sum(n), sum(n))), "scale": np.concatenate([x["scale"] for x in xs]), "f": np.concatenate([x["f"] for x in xs]), "at": np.cumsum([0, *n[:-1]])}
        for x, k, m in zip(xs, out["at"], n, strict=True):
            out["a"][k : k + m, k : k + m] = x["a"]
        out["diag"] = [np.concatenate(d) for d in zip(*(x["diag"] for x in xs), strict=True)]
        return out

    def sums(t, x, y):
        return np.add.reduceat(np.add.reduceat(t, x["at"], axis=0), y["at"], axis=1)

    def block(xs, ys):
        x, y = together(xs), together(ys)
        raw = product(x, y)
        s = gather(raw, x, y)
        t, total, at = s.copy(), sums(raw, x, y), 0
        for layer in range(1, num_layers):
            for _ in range(mlps):
                s, slope = arc_step(s, x["diag"][at], y["diag"][at])
                t, at = t * slope + s, at + 1
            if jk:
                total += sums(t, x, y)
            if layer < num_layers - 1:
                s, t = gather(s, x, y), gather(t, x, y)
        return 2 * (total if jk else sums(t, x, y))

    return gram.by_blocks(gs_rows, block, block=gram.SMALL_BLOCK, prep=prep, whole=True, pairs=gs.pairs)


def kernel(gs: GraphSet, num_layers: int, num_mlp_layers: int | None = None, jk: bool = True, scale: str = "uniform", degree_as_tag: bool = True, use_attr: bool = False) -> DataFrame:
    """deep, which costs a matrix product per pair of blocks where two_layers shuffles every node pair. The number of perceptron layers defaults to num_layers."""
    return deep(gs, num_layers, num_layers if num_mlp_layers is None else num_mlp_layers, jk, scale, degree_as_tag, use_attr)
