"""Random-walk kernels: as sums of walk moments (joins), or at rank r from spectra (NumPy in pair blocks)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import inverse_or_zero
from ..model import GraphSet
from ..plans.lineage import cut
from . import blocked, gram

#: Edge labels for which the arcs are repeated.
VOCABULARY = 1000
KINDS = ("RW_ARKU", "RW_ARKU_plus", "RW_ARKU_edge", "RW_ARKL")


def start_weights(gs: GraphSet, use_attr: bool = False) -> DataFrame:
    """(graph_id, node_id, p): start and stop weights, 1/n or the first component of the node's attribute."""
    n = gs.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    if use_attr:
        return gs.nodes.select("graph_id", "node_id", F.element_at("attr", 1).alias("p"))
    return gs.nodes.select("graph_id", "node_id").join(n, "graph_id").select("graph_id", "node_id", (1.0 / F.col("n")).alias("p"))


def scaled_arcs(gs: GraphSet) -> DataFrame:
    """Arcs of D^-1 A': entry (u, v) is A_vu over u's unweighted degree (out-degree where directed); degree 0 gives 0."""
    out = gs.edges.join(gs.graphs.select("graph_id", "directed"), "graph_id").where("directed").groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("d"))
    und = gs.degrees().join(gs.graphs.where("not directed").select("graph_id"), "graph_id").select("graph_id", "node_id", F.col("degree").alias("d"))
    deg = out.unionAll(und).select("graph_id", F.col("node_id").alias("src"), "d")
    back = gs.arcs().select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return back.join(deg, ["graph_id", "src"], "left").select("graph_id", "src", "dst", (F.col("weight") * inverse_or_zero(F.coalesce("d", F.lit(0)))).alias("weight"))


def walk(start: DataFrame, arcs: DataFrame, steps: int, keys: list[str]) -> DataFrame:
    """start (keys..., node_id, v0, ...) with v1 .. v_steps: each the weighted sum of the one before over a node's arcs."""
    now = start
    for k in range(1, steps + 1):
        last = f"v{k - 1}"
        got = arcs.join(now.select(*keys, F.col("node_id").alias("dst"), last), [*[c for c in keys if c in arcs.columns], "dst"]).groupBy(*keys, F.col("src").alias("node_id")).agg(F.sum(F.col("weight") * F.col(last)).alias(f"v{k}"))
        now = now.join(got, [*keys, "node_id"], "left").withColumn(f"v{k}", F.coalesce(f"v{k}", F.lit(0.0)))
        if k % 2 == 0 and k < steps:
            now = cut(now)
    return now


def moments(gs: GraphSet, kind: str, terms: int, use_attr: bool = False, labels: list[str] | None = None, label_mode: str = "exclude") -> DataFrame:
    """(graph_id, feature, power, v): the walk moments whose products, weighted by c^power, add up to the kernel."""
    p = start_weights(gs, use_attr)
    each = lambda df, first: F.explode(F.array(*[F.struct(F.lit(k).alias("power"), F.col(f"m{k}").alias("v")) for k in range(first, terms + 1)])).alias("e")
    sums = lambda first: [F.sum(F.col("p") * F.col(f"v{k}")).alias(f"m{k}") for k in range(first, terms + 1)]
    if kind in ("RW_ARKU", "RW_ARKU_plus"):
        arcs = scaled_arcs(gs) if kind == "RW_ARKU" else gs.arcs().select("graph_id", "src", "dst", "weight")
        v = walk(p.withColumn("v0", F.col("p")), arcs, terms, ["graph_id"])
        m = v.groupBy("graph_id").agg(*sums(0))
        return m.select("graph_id", each(m, 0)).select("graph_id", F.col("e.power").cast("string").alias("feature"), "e.power", "e.v")
    base = p.groupBy("graph_id").agg(F.sum(F.col("p") * F.col("p")).alias("v")).select("graph_id", F.lit("0").alias("feature"), F.lit(0).alias("power"), "v")
    if kind == "RW_ARKU_edge":
        spark = gs.nodes.sparkSession
        vocab = spark.createDataFrame([(x,) for x in labels], "l string") if labels else gs.edges.select(F.col("edge_label").alias("l")).distinct()
        if vocab.limit(VOCABULARY + 1).count() > VOCABULARY:
            raise ValueError(f"more than {VOCABULARY} edge labels: every arc would be repeated for each")
        own = F.col("edge_label").eqNullSafe(F.col("l"))
        arcs = gs.arcs().crossJoin(F.broadcast(vocab)).where(~own if label_mode == "exclude" else own).select("graph_id", "l", "src", "dst", "weight")  # VOCABULARY labels at most
        v = walk(p.crossJoin(F.broadcast(vocab)).withColumn("v0", F.col("p")), arcs, terms, ["graph_id", "l"])
        m = v.groupBy("graph_id", "l").agg(*sums(1))
        return base.unionByName(m.select("graph_id", "l", each(m, 1)).select("graph_id", F.concat_ws(":", F.col("e.power").cast("string"), "l").alias("feature"), "e.power", "e.v"))
    if kind == "RW_ARKL":
        lab = gs.nodes.select("graph_id", "node_id", "label")
        lab = lab.where(F.col("label").isin(labels)) if labels else lab
        # walks that start at a label: one vector per label; intermediate nodes need a label of the vocabulary
        mask = lab.select("graph_id", "node_id", F.col("label").alias("at"))
        nodes = mask.select("graph_id", "node_id", "at").join(p, ["graph_id", "node_id"])
        ends = nodes.select("graph_id", F.col("at").alias("l")).distinct()
        v0 = nodes.join(ends, "graph_id").withColumn("v0", F.when(F.col("at") == F.col("l"), F.col("p")).otherwise(0.0))
        back = gs.arcs().select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        v = walk(v0, back, terms, ["graph_id", "l"])
        m = v.groupBy("graph_id", "l", "at").agg(*sums(1))
        f = m.select("graph_id", "l", "at", each(m, 1))
        return base.unionByName(f.select("graph_id", F.concat_ws(":", F.col("e.power").cast("string"), "at", "l").alias("feature"), "e.power", "e.v"))
    raise ValueError(f"kernel must be one of {KINDS}, not {kind!r}")


def series(gs: GraphSet, kind: str, c: float, terms: int = 6, use_attr: bool = False, labels: list[str] | None = None, label_mode: str = "exclude") -> DataFrame:
    """The kernel at full rank, to `terms` steps: sum over k of c^k m_k(i) m_k(j)."""
    gs.validate(label=kind == "RW_ARKL", edge_label=kind == "RW_ARKU_edge", undirected=kind != "RW_ARKU")
    f = moments(gs, kind, terms, use_attr, labels, label_mode)
    scaled = f.select("graph_id", F.concat_ws("|", F.col("power").cast("string"), "feature").alias("feature"), "v", F.pow(F.lit(float(c)), F.col("power")).alias("w"))
    pooled = gs.pooled()
    size = F.sum(F.sqrt(F.abs("w")) * F.abs("v")).over(Window.partitionBy("ord"))  # the terms of a pair add up to the product of its sizes at most
    at = scaled.join(pooled.select("graph_id", "ord"), "graph_id").select("ord", "feature", F.struct("v", size.alias("size")).alias("v"), "w")
    k = gram.wanted(at, gs.pairs, "w").groupBy("i", "j").agg(gram.steady_sum(F.col("w") * F.col("a.v") * F.col("b.v"), F.col("a.size") * F.col("b.size")).alias("k"))
    return (gram.all_pairs(pooled) if gs.pairs is None else gs.pairs).join(k, ["i", "j"], "left").select("i", "j", F.coalesce("k", F.lit(0.0)).alias("k"))


def spectral_radius_bound(gs: GraphSet) -> float:
    """The largest absolute row sum of all adjacencies: the series converges if c times its square is below 1."""
    r = gs.arcs().groupBy("graph_id", "src").agg(F.sum(F.abs("weight")).alias("s")).agg(F.max("s")).first()[0]
    return float(r or 0.0)


def graph_rows(gs: GraphSet, use_attr: bool = False) -> DataFrame:
    """One row per graph for the NumPy kernels: ord, directed, n, p, labels, attrs (in order of node_id), arcs (src, dst, weight, edge_label) and edges."""
    p = start_weights(gs, use_attr)
    nodes = gs.nodes.join(p, ["graph_id", "node_id"]).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "p", "label", "attr"))).alias("nodes"))
    arcs = gs.arcs().groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "weight", "edge_label")).alias("arcs"))
    return gs.pooled().select("graph_id", "ord", "directed").join(nodes, "graph_id").join(arcs, "graph_id", "left").drop("graph_id")


def adjacency(row: dict, keep=None) -> np.ndarray:
    at = {x["node_id"]: k for k, x in enumerate(row["nodes"])}
    a = np.zeros((len(at), len(at)))
    for e in row["arcs"] if row["arcs"] is not None else ():
        if keep is None or keep(e["edge_label"]):
            a[at[e["src"]], at[e["dst"]]] = e["weight"]
    return a


def top_modes(a: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """The r eigenvalues of largest absolute value that are not zero, with their vectors."""
    lam, u = np.linalg.eigh(a)
    pick = np.argsort(-np.abs(lam), kind="stable")[:r]
    pick = pick[np.abs(lam[pick]) > 1e-12]
    return lam[pick], u[:, pick]


#: A core whose eigenvectors are worse conditioned than this is not diagonalised; the pairs of its graph are solved as they are.
CONDITION = 1e5
FACTORS = "ord int, base double, mu array<array<double>>, sigma array<array<double>>"
CORES = "ord int, base double, k int, channels int, whole boolean, mu array<double>, left array<double>, right array<double>, w array<double>, core array<double>"


def labels_of(gs: GraphSet, kind: str, labels: list[str] | None) -> list[str] | None:
    """The vocabulary of a kernel with labels, given or found."""
    if kind == "RW_ARKU_edge" and not labels:
        return [x[0] for x in gs.edges.select("edge_label").distinct().orderBy("edge_label").collect()]
    if kind == "RW_ARKL" and not labels:
        return [x[0] for x in gs.nodes.select("label").distinct().orderBy("label").collect()]
    return labels


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: a decomposition is work, not bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "ord")


def spectra(gs: GraphSet, kind: str, r: int, use_attr: bool = False, labels: list[str] | None = None, label_mode: str = "exclude") -> DataFrame:
    """FACTORS of RW_ARKU_plus and RW_ARKU_edge: of each channel (the one adjacency, or a label's) the r leading eigenvalues mu and sigma = mu (p . u)^2. One decomposition per graph and channel."""
    other = (lambda l: lambda e: e != l) if label_mode == "exclude" else (lambda l: lambda e: e == l)  # noqa: E741
    keeps = [None] if kind == "RW_ARKU_plus" else [other(l) for l in labels]  # noqa: E741

    def run(it):
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                p = np.array([x["p"] for x in row["nodes"]])
                modes = [top_modes(adjacency(row, keep), r) for keep in keeps]
                out.append((row["ord"], float(p @ p), [lam.tolist() for lam, _ in modes], [(lam * (p @ u) ** 2).tolist() for lam, u in modes]))
            yield pd.DataFrame(out, columns=["ord", "base", "mu", "sigma"])

    return cut(spread(graph_rows(gs, use_attr)).mapInPandas(run, FACTORS))


def from_spectra(s: DataFrame, c: float, pairs: DataFrame | None = None) -> DataFrame:
    """pi_i pi_j + c sum over channels and modes a, b of sigma_a sigma_b / (1 - c mu_a mu_b), by array functions on stored spectra."""

    def value(a: str, b: str) -> Column:
        inner = f"aggregate(arrays_zip(y.m, y.s), 0D, (t, v) -> t + v.s / (1D - {c!r}D * u.m * v.m))"
        channel = f"aggregate(arrays_zip(x.m, x.s), 0D, (t, u) -> t + u.s * {inner})"
        zipped = lambda p: f"transform(arrays_zip({p}mu, {p}sigma), z -> named_struct('m', z.{p}mu, 's', z.{p}sigma))"
        total = f"aggregate(zip_with({zipped(a)}, {zipped(b)}, (x, y) -> {channel}), 0D, (t, x) -> t + x)"
        return F.expr(f"{a}base * {b}base + {c!r}D * {total}")

    return gram.native_blocks(s, value, pairs=pairs)


def tiles_from_spectra(s: DataFrame, n: int, c: float, r: int, channels: int) -> blocked.Tiles:
    """from_spectra in tiles: the same sums in the same order, a mode of a block of graphs against one of another block at a time."""
    wide = channels * r

    def pack(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), 1 + 2 * wide))  # missing modes add 0
        for k, (base, mu, sigma) in enumerate(zip(pdf["base"], pdf["mu"], pdf["sigma"], strict=True)):
            out[k, 0] = base
            for ch in range(channels):
                at = 1 + ch * r
                out[k, at : at + len(mu[ch])], out[k, at + wide : at + wide + len(mu[ch])] = mu[ch], sigma[ch]
        return out

    def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros((len(a), len(b)))
        for ch in range(channels):
            modes = range(1 + ch * r, 1 + ch * r + r)
            channel = np.zeros_like(total)
            for u in modes:
                inner = np.zeros_like(total)
                for v in modes:
                    inner += b[None, :, v + wide] / (1 - (c * a[:, u])[:, None] * b[None, :, v])
                channel += a[:, u + wide][:, None] * inner
            total += channel
        return np.outer(a[:, 0], b[:, 0]) + c * total

    return blocked.computed(s, n, pack, value)


def cores(gs: GraphSet, kind: str, r: int, use_attr: bool = False, labels: list[str] | None = None) -> DataFrame:
    """CORES of RW_ARKU and RW_ARKL: the rank-r factors of each graph, its r x r core diagonalised.

    With X = U diag(w) V' of rank r and M = diag(w) V'U (with labels V'DU), a pair's kernel holds the inverse of
    I - c M_i x M_j. M = P diag(mu) P^-1 makes that diagonal, so a pair costs r^2 divisions in place of an inverse of r^2 rows. Complex
    numbers are stored as alternating real and imaginary parts. A core that is (near) defective is kept
    as it is (whole).
    """

    def run(it):
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                a, p = adjacency(row), np.array([x["p"] for x in row["nodes"]])
                if kind == "RW_ARKU":
                    d = (a != 0).sum(axis=1) + (0 if row["directed"] else (np.diag(a) != 0))
                    x, ends, mask = a.T / np.where(d > 0, d, 1)[:, None] * (d > 0)[:, None], p[None, :], np.ones(len(p))
                else:
                    is_ = np.array([[v["label"] == l for v in row["nodes"]] for l in labels], float)  # noqa: E741
                    x, ends, mask = a.T, is_ * p, is_.sum(axis=0)
                u, w, vt = np.linalg.svd(x)
                keep = [k for k in range(min(r, len(w))) if w[k] > 1e-12]
                u, w, vt = u[:, keep], w[keep], vt[keep]
                left, right, core = ends @ u, ends @ vt.T, vt @ (mask[:, None] * u)
                mu, vectors = np.linalg.eig(w[:, None] * core)
                whole = bool(len(keep) and np.linalg.cond(vectors) > CONDITION)
                if whole:
                    mu = np.zeros(0, complex)
                else:
                    left, right = left @ vectors, np.linalg.solve(vectors, (w * right).T).T if len(keep) else right
                out.append((row["ord"], float(p @ p), len(keep), len(ends), whole, *(v.astype(complex).ravel().view(float).tolist() for v in (mu, left, right)), w.tolist(), core.ravel().tolist()))
            yield pd.DataFrame(out, columns=["ord", "base", "k", "channels", "whole", "mu", "left", "right", "w", "core"])

    return cut(spread(graph_rows(gs, use_attr)).mapInPandas(run, CORES))


def from_cores(s: DataFrame, c: float, pairs: DataFrame | None = None) -> DataFrame:
    """The kernel from stored cores: c sum over a, b of (L_i' L_j)_ab (R_i' R_j)_ab / (1 - c mu_a mu_b) beside pi_i pi_j, a graph against a block at a time."""

    def read(row):
        shape = (row["channels"], row["k"])
        number = lambda v, to: np.asarray(v, float).view(complex).reshape(to)
        return row["base"], row["whole"], number(row["mu"], -1), number(row["left"], shape), number(row["right"], shape), np.asarray(row["w"], float), np.asarray(row["core"], float).reshape(row["k"], row["k"])

    def factors(x):
        """Left and right of a core as it is: also of one that was diagonalised."""
        base, whole, mu, left, right, w, core = x
        return (left, w * right, w[:, None] * core) if whole else (left, right, np.diag(mu))

    def solved(x, y):
        (l1, r1, m1), (l2, r2, m2) = factors(x), factors(y)
        if not len(m1) or not len(m2):
            return 0.0
        inverse = np.eye(len(m1) * len(m2)) - c * np.kron(m1, m2)
        return float(((l1.T @ l2).ravel() @ np.linalg.solve(inverse, (r1.T @ r2).ravel())).real)

    def block(xs, ys):
        widest = max((len(y[2]) for y in ys), default=0)
        mu, left, right = np.zeros((len(ys), widest), complex), *(np.zeros((len(ys), ys[0][3].shape[0], widest), complex) for _ in range(2))
        for n, y in enumerate(ys):
            if not y[1]:
                mu[n, : len(y[2])], left[n, :, : len(y[2])], right[n, :, : len(y[2])] = y[2], y[3], y[4]
        out = np.outer([x[0] for x in xs], [y[0] for y in ys])
        for n, x in enumerate(xs):
            if not x[1] and len(x[2]) and widest:
                parts = np.einsum("la,nlb->nab", x[3], left) * np.einsum("la,nlb->nab", x[4], right) / (1 - c * x[2][None, :, None] * mu[:, None, :])
                out[n] += c * parts.sum(axis=(1, 2)).real
            for m, y in enumerate(ys):
                if x[1] or y[1]:
                    out[n, m] = x[0] * y[0] + c * solved(x, y)
        return out

    return gram.by_blocks(s, block, prep=read, whole=True, pairs=pairs)


def checked(gs: GraphSet, kind: str, r: int, labels: list[str] | None) -> list[str] | None:
    """labels_of, or ValueError."""
    if r < 1:
        raise ValueError("r must be 1 or more")
    if kind not in KINDS:
        raise ValueError(f"kernel must be one of {KINDS}, not {kind!r}")
    gs.validate(label=kind == "RW_ARKL", edge_label=kind == "RW_ARKU_edge", undirected=kind != "RW_ARKU")
    return labels_of(gs, kind, labels)


def spectral_tiles(gs: GraphSet, kind: str, c: float, r: int, use_attr: bool = False, labels: list[str] | None = None, label_mode: str = "exclude") -> blocked.Tiles:
    """spectral of RW_ARKU_plus and RW_ARKU_edge, all pairs, in tiles."""
    labels = checked(gs, kind, r, labels)
    s = spectra(gs, kind, r, use_attr, labels, label_mode)
    return tiles_from_spectra(s, s.count(), c, r, 1 if kind == "RW_ARKU_plus" else len(labels))


def spectral(gs: GraphSet, kind: str, c: float, r: int, use_attr: bool = False, labels: list[str] | None = None, label_mode: str = "exclude") -> DataFrame:
    """The kernel from each graph's r leading modes: each graph is decomposed once, in all tasks, and pairs meet the stored spectra."""
    labels = checked(gs, kind, r, labels)
    if kind in ("RW_ARKU_plus", "RW_ARKU_edge"):
        return from_spectra(spectra(gs, kind, r, use_attr, labels, label_mode), c, gs.pairs)
    return from_cores(cores(gs, kind, r, use_attr, labels), c, gs.pairs)
