"""Kernels that were reached through another library, by their settings: label and edge histograms, shortest paths, random walks, propagation, pyramid match."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import GraphSet
from ..plans.lineage import cut
from . import gram, walks, wl


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) fixed by its arguments."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def propagation(gs: GraphSet, t_max: int = 5, w: float = 0.01, metric: str = "TV", seed: int = 0, use_attr: bool = False) -> DataFrame:
    """Propagation kernel (Neumann et al. 2016): distributions diffuse along transition rows; in each round nodes fall into bins of a random projection, and common bins are counted.

    metric 'TV' draws Cauchy directions, 'L1' too, 'L2' and 'H' Gaussian ones ('H' on square roots); the draws are
    fixed by the seed, the round and the dimension. A node without neighbours has no distribution after round 0: its bin is that of the shift.
    """
    if metric not in ("TV", "L1", "L2", "H"):
        raise ValueError("metric must be TV, L1, L2 or H")
    if use_attr:
        now = gs.nodes.select("graph_id", "node_id", F.posexplode("attr").alias("d", "v")).select("graph_id", "node_id", F.col("d").cast("string").alias("dim"), "v")
    else:
        now = gs.nodes.select("graph_id", "node_id", F.coalesce("label", F.lit("-1")).alias("dim"), F.lit(1.0).alias("v"))
    arcs = gs.arcs().select("graph_id", "src", "dst")
    deg = arcs.groupBy("graph_id", "src").agg(F.count("*").alias("n"))
    step = arcs.join(deg, ["graph_id", "src"]).select("graph_id", "src", "dst", (1.0 / F.col("n")).alias("p"))
    counts = None
    for t in range(t_max + 1):
        u = hash_unit(F.lit(str(seed)), F.lit(str(t)), F.col("dim"))
        u2 = hash_unit(F.lit(f"{seed}b"), F.lit(str(t)), F.col("dim"))
        draw = F.tan(np.pi * (u - 0.5)) if metric in ("TV", "L1") else F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * u2)
        shift = w * hash_unit(F.lit(str(seed)), F.lit(str(t)), F.lit("shift"))
        value = F.sqrt("v") if metric == "H" else F.col("v")
        placed = gs.nodes.select("graph_id", "node_id").join(now.groupBy("graph_id", "node_id").agg(F.sum(value * draw).alias("x")), ["graph_id", "node_id"], "left")
        bins = placed.select("graph_id", F.floor((F.coalesce("x", F.lit(0.0)) + shift) / w).alias("bin"))
        c = bins.groupBy("graph_id", F.concat_ws("+", F.lit(str(t)), F.col("bin").cast("string")).alias("feature")).agg(F.count("*").cast("double").alias("v"))
        counts = c if counts is None else counts.unionAll(c)
        if t < t_max:
            now = cut(step.join(now.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id"), "dim").agg(F.sum(F.col("p") * F.col("v")).alias("v")))
    return gram.dot(counts, gs.pooled(), pairs=gs.pairs)


def eigen_coordinates(gs: GraphSet, dims: int) -> DataFrame:
    """(graph_id, node_id, dim, x): nodes in [0, 1]^dims by the eigenvectors of the eigenvalues largest in size, without sign; 0 where a graph has fewer. One decomposition per graph."""

    def run(it):
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                a = walks.adjacency(row)
                lam, u = np.linalg.eigh((a + a.T) / 2)
                x = np.zeros((len(a), dims))
                pick = np.argsort(-np.abs(lam), kind="stable")[:dims]
                x[:, : len(pick)] = np.abs(u[:, pick])
                out += [(row["ord"], v["node_id"], d, float(x[k, d])) for k, v in enumerate(row["nodes"]) for d in range(dims)]
            yield pd.DataFrame(out, columns=["ord", "node_id", "dim", "x"])

    at = cut(walks.spread(walks.graph_rows(gs)).mapInPandas(run, "ord int, node_id int, dim int, x double"))
    return at.join(gs.pooled().select("ord", "graph_id"), "ord").drop("ord")


def pyramid_match(gs: GraphSet, levels: int = 4, dims: int = 6, with_labels: bool = True, use_attr: bool = False) -> DataFrame:
    """Pyramid match kernel (Nikolentzos et al. 2017): nodes as points of the unit cube, histogram intersections over 2^l cells a side, new matches of coarser levels at half weight per level.

    Points are eigenvector coordinates or, with use_attr, the nodes' attributes (all of them, held to [0, 1]; a node without any
    matches nothing). The sum over levels gives each level one weight, a power of two, so that the kernel is one
    join of cells on the least of two weighted counts; levels make nodes * dims * levels rows of a graph, cells fewer.
    """
    if use_attr:
        points = gs.nodes.select("graph_id", "node_id", F.posexplode("attr").alias("dim", "x")).where("x is not null and not isnan(x)")
    else:
        points = eigen_coordinates(gs, dims)
    if with_labels:
        points = points.join(gs.nodes.select("graph_id", "node_id", "label"), ["graph_id", "node_id"])
    else:
        points = points.withColumn("label", F.lit(None).cast("string"))
    placed = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.pow(F.lit(2.0), F.col("level"))
    cell = F.least(F.floor(F.greatest("x", F.lit(0.0)) * side), side - 1).cast("long")
    weight = F.pow(F.lit(2.0), F.greatest("level", F.lit(1)) - levels)
    cells = placed.groupBy("graph_id", "level", F.struct("level", "label", "dim", cell.alias("cell")).alias("cell")).agg((F.count("*") * weight).alias("v"))
    return gram.dot(cells.select("graph_id", F.to_json("cell").alias("feature"), "v"), gs.pooled(), lambda a, b: F.sum(F.least(a, b)), pairs=gs.pairs)


def shortest_path(gs: GraphSet, with_labels: bool = True) -> DataFrame:
    """Shortest-path kernel (Borgwardt and Kriegel 2005): inner products of the counts of (label, label, distance) over ordered pairs of different nodes."""
    own = gs if with_labels else GraphSet(gs.graphs, gs.nodes.withColumn("label", F.lit("")), gs.edges, gs.pairs)
    f = wl.shortest_path_counts(own, ordered=True)
    return gram.dot(f.select("graph_id", "feature", F.col("n").cast("double").alias("v")), gs.pooled(), pairs=gs.pairs)


def edge_histogram(gs: GraphSet) -> DataFrame:
    """Inner products of the counts of arcs by edge label."""
    f = gs.arcs().groupBy("graph_id", F.coalesce("edge_label", F.lit("-1")).alias("feature")).agg(F.count("*").cast("double").alias("v"))
    return gram.dot(f, gs.pooled(), pairs=gs.pairs)


def random_walk(gs: GraphSet, lamda: float = 0.1, p: int | None = None) -> DataFrame:
    """Random-walk kernel (Gaertner, Flach and Wrobel 2003; Vishwanathan et al. 2010): the sum of all entries of (I - lamda A x B)^-1, or of the first p + 1 terms of its series; edge weights do not count."""

    def prep(row):
        a = (walks.adjacency(row) != 0).astype(float)
        return a, np.linalg.eigvals(a).astype(complex)

    def pair(x, y):
        s = np.ones((len(x[0]), len(y[0])))
        if p is None:
            if len(x[1]) and len(y[1]) and lamda * np.abs(x[1]).max() * np.abs(y[1]).max() >= 1:
                raise ValueError("the walks do not converge; try a lower lamda, or p")
            n = s.size
            return float(np.linalg.solve(np.eye(n) - lamda * np.kron(x[0], y[0]), s.ravel()).sum()) if n else 0.0
        total = s.sum()
        for _ in range(p):
            s = lamda * (x[0] @ s @ y[0].T)
            total += s.sum()
        return float(total)

    return gram.by_blocks(walks.graph_rows(gs), pair, prep=prep, pairs=gs.pairs)


def by_name(gs: GraphSet, spec: list[dict]) -> DataFrame:
    """A kernel from a list of settings as the adapter takes them.

    [{'name': 'weisfeiler_lehman', 'n_iter': 2}, {'name': 'vertex_histogram'}], vertex_histogram, edge_histogram,
    shortest_path (with_labels), random_walk (lamda, p), weisfeiler_lehman_optimal_assignment (n_iter), propagation or pyramid_match.
    """
    names, first = [s["name"].lower() for s in spec], spec[0]
    if names[0] in ("weisfeiler_lehman", "wl") and (len(names) == 1 or names[1] in ("vertex_histogram", "vh", "subtree_wl")):
        return wl.vertex_histogram(gs, first.get("n_iter", 5))
    if names[0] in ("weisfeiler_lehman_optimal_assignment", "wl_oa"):
        return wl.optimal_assignment(gs, first.get("n_iter", 5))
    if names[0] in ("vertex_histogram", "vh", "subtree_wl"):
        return wl.vertex_histogram(gs, 0)
    if names[0] in ("edge_histogram", "eh"):
        return edge_histogram(gs)
    if names[0] in ("shortest_path", "sp"):
        return shortest_path(gs, first.get("with_labels", True))
    if names[0] in ("random_walk", "rw"):
        return random_walk(gs, first.get("lamda", 0.1), first.get("p"))
    if names[0] in ("propagation", "pk"):
        use_attr = bool(gs.nodes.where("attr is not null").limit(1).count()) and first.get("M") in ("L1", "L2")
        return propagation(gs, first.get("t_max", 5), first.get("w", 0.01), first.get("M", "TV"), first.get("random_state", 0), use_attr)
    if names[0] in ("pyramid_match", "pm"):
        return pyramid_match(gs, first.get("L", 4), first.get("d", 6), first.get("with_labels", True), first.get("use_attr", False))
    raise ValueError(f"no kernel for {names}; see by_name")
