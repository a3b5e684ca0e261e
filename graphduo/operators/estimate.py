"""Graphs from data matrices: row windows, nonparanormal transform, graphical lasso, model choice by EBIC."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import normal_quantile, normal_quantiles, truncation
from ..model import GraphSet
from . import lasso

#: Entries of a precision matrix below this are zero.
ZERO = 1e-3


def windows(obs: DataFrame, size: int, tasks: int | None = None) -> DataFrame:
    """obs with win: tumbling windows of `size` successive row_idx per sample; incomplete ones are dropped. tasks: windows are dealt to so many, for work that goes by windows and not by bytes."""
    w = obs.withColumn("win", F.floor(F.col("row_idx") / size).cast("long"))
    w = w.repartition(tasks, "sample", "win") if tasks else w
    full = w.groupBy("sample", "win").agg(F.count("*").alias("n")).where(F.col("n") == size).select("sample", "win")
    return w.join(full, ["sample", "win"])


def long_form(win: DataFrame) -> DataFrame:
    """(sample, win, row_idx, col, x)"""
    return win.select("sample", "win", "row_idx", F.posexplode("x").alias("col", "x"))


def average_ranks(values: DataFrame) -> DataFrame:
    """values with r: rank of x within (sample, win, col), ties sharing their mean rank; and n, mean and population deviation of the column."""
    group = ["sample", "win", "col"]
    ties = F.count("*").over(Window.partitionBy(*group, "x"))
    rank = F.rank().over(Window.partitionBy(*group).orderBy("x"))
    whole = Window.partitionBy(*group)
    return values.select("*", (rank + (ties - 1) / 2).alias("r"), F.count("*").over(whole).alias("n"), F.avg("x").over(whole).alias("mean"), F.sqrt(F.var_pop("x").over(whole)).alias("sd"))


def nonparanormal(values: DataFrame) -> DataFrame:
    """(sample, win, row_idx, col, x): Gaussian scores of the clipped ranks, with the column's own mean and deviation."""
    r = average_ranks(values)
    d = truncation(F.col("n"))
    p = F.greatest(d, F.least(1 - d, F.col("r") / F.col("n")))
    return r.select("sample", "win", "row_idx", "col", (F.col("mean") + F.col("sd") * normal_quantile(p)).alias("x"))


# --- one window, in NumPy ---------------------------------------------------------------------------


def gaussian_scores(x: np.ndarray) -> np.ndarray:
    """nonparanormal for a matrix."""
    n = len(x)
    ranks = pd.DataFrame(x).rank(method="average").to_numpy() / n
    d = 1 / (4 * n**0.25 * np.sqrt(np.pi * np.log(n)))
    return x.mean(axis=0) + x.std(axis=0) * normal_quantiles(np.clip(ranks, d, 1 - d))


def graphical_lasso(s: np.ndarray, alpha: float, **solver) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, precision) of the l1-penalised likelihood, off-diagonal entries penalised. solver: max_iter, tol, enet_tol of lasso.path."""
    _, w, theta = next(lasso.path(s, [alpha], **solver))
    return w, theta


def log_likelihood(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float:
    """Gaussian, with pseudo-inverse and pseudo-determinant where the covariance is singular."""
    return part_likelihood(cov, (x - mean).T @ (x - mean) / len(x), len(x), singular(cov))


def singular(cov: np.ndarray) -> float:
    """Eigenvalues up to this count as zero."""
    return 1e-10 * max(float(np.linalg.eigvalsh(cov).max()), 1e-300)


def part_likelihood(cov: np.ndarray, moment: np.ndarray, n: int, least: float) -> float:
    """log_likelihood of some columns that have no covariance with others, from their second moments about the mean: the parts of a window add up."""
    lam, u = np.linalg.eigh(cov)
    keep = lam > least
    lam, u = lam[keep], u[:, keep]
    return float(-0.5 * n * (len(lam) * np.log(2 * np.pi) + np.log(lam).sum() + (np.einsum("ik,ij,jk->k", u, moment, u) / lam).sum()))


def ebic(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, precision: np.ndarray, beta: float) -> float:
    """Extended BIC; edges are counted with the diagonal's loops, a constant of the penalty."""
    return criterion(log_likelihood(x, mean, cov), len(x), len(precision), pairs(precision), beta)


def pairs(precision: np.ndarray) -> int:
    return int((np.abs(precision[np.triu_indices(len(precision), 1)]) >= ZERO).sum())


def criterion(likelihood, n, p, found, beta: float, log=np.log):
    """ebic from its parts, numbers or columns."""
    return -2 * likelihood + (p + found) * (log(n) + 4 * beta * log(p))


def centred(x: np.ndarray, scores: bool = False, scale: str | bool = False, assume_centered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, mean, covariance) of a window: Gaussian scores keep the raw mean. scale='zscore' standardises; True is accepted and does nothing."""
    mean = x.mean(axis=0)
    if scores:
        x = gaussian_scores(x)
    if scale == "zscore":
        x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12)
        mean = x.mean(axis=0)
    s = x.T @ x / len(x) if assume_centered else np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])
    return x, mean, s


def fit_window(x: np.ndarray, alphas: list[float], beta: float, scores: bool = False, scale: str | bool = False, assume_centered: bool = False, **solver) -> tuple[np.ndarray, list[float], int]:
    """(precision of the best alpha, EBIC of each, its index): the first minimum. scale, solver: as in estimate_graphs."""
    x, mean, s = centred(x, scores, scale, assume_centered)
    thetas, values = [None] * len(alphas), [0.0] * len(alphas)
    for k, cov, theta in lasso.path(s, alphas, **solver):
        thetas[k] = np.where(np.abs(theta) < ZERO, 0.0, theta)
        values[k] = ebic(x, mean, cov, theta, beta)
    best = int(np.argmin(values))
    return thetas[best], values, best


PART = "struct<part int, lone boolean, n int, p int, least double, cols array<int>, s array<double>, moment array<double>>"
MADE = f"sample int, win long, nodes array<struct<node_id int, label string, attr array<double>>>, parts array<{PART}>"


def estimate_graphs(obs: DataFrame, window_size: int, alpha: float | list[float], beta: float, nonparanormal: bool = False, scale: str | bool = False, set_attributes: Callable | None = None, set_labels: str | Callable | dict | None = None, **solver) -> GraphSet:
    """A graph for each window: nodes are the columns, edges the off-diagonal entries of the chosen precision matrix, weight = entry.

    set_attributes: submatrix -> a vector per node. set_labels: 'degree', a function submatrix ->
    {node: label}, or {'1': {node: label}, '2': ...}. solver: max_iter, tol, enet_tol, assume_centered of the lasso.

    A window is one task's work only for its covariance. Columns that the least penalty keeps apart
    are rows of their own for the lasso (a window's path is independent in each), and likelihoods and edge counts of the rows
    add up to the EBIC of a penalty, so the choice is an aggregation. Tasks are as many as the windows can fill, whatever
    their bytes: a window of a few kilobytes is seconds of work.
    """
    if not 0 <= beta <= 1:
        raise ValueError("beta must be between 0 and 1")
    if isinstance(set_labels, str) and set_labels != "degree":
        raise ValueError("set_labels must be 'degree', a function or a dict")
    if unknown := set(solver) - {"max_iter", "tol", "enet_tol", "assume_centered"}:
        raise TypeError(f"no such solver option: {', '.join(sorted(unknown))}")
    alphas = [float(a) for a in (alpha if hasattr(alpha, "__len__") else [alpha])]
    shapes = obs.groupBy("sample").agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).collect()
    if len({r["n"] for r in shapes}) > 1:
        warnings.warn("the samples have different numbers of rows", stacklevel=2)
    if len({x for r in shapes for x in (r["lo"], r["hi"])}) > 1:
        warnings.warn("rows have different numbers of columns", stacklevel=2)
    scores, labels, centre = nonparanormal, set_labels if callable(set_labels) else None, solver.pop("assume_centered", False)
    tasks = tasks_for(obs.sparkSession, sum(r["n"] // window_size for r in shapes))

    def prepare(key, pdf):
        x = np.stack(pdf.sort_values("row_idx")["x"].to_list()).astype(float)
        attr = None if set_attributes is None else [[float(v) for v in np.atleast_1d(a)] for a in set_attributes(x)]
        lab = labels(x) if labels else {}
        nodes = [{"node_id": k, "label": None if lab.get(k) is None else str(lab[k]), "attr": None if attr is None else attr[k]} for k in range(x.shape[1])]
        x, mean, s = centred(x, scores, scale, centre)
        moment, least = (x - mean).T @ (x - mean) / len(x), singular(s)
        found = [c for c in lasso.Components(s).at(min(alphas)) if len(c) > 1]
        parts = [{"part": k, "lone": len(found) == 1, "n": len(x), "p": len(s), "least": least, "cols": c.tolist(), "s": s[np.ix_(c, c)].ravel(), "moment": moment[np.ix_(c, c)].ravel()} for k, c in enumerate(found)]
        return pd.DataFrame([{"sample": int(key[0]), "win": int(key[1]), "nodes": nodes, "parts": parts}])

    def solve(it):
        for pdf in it:
            yield pd.DataFrame([r for row in pdf.itertuples() for r in solved(row, alphas, beta, solver)], columns=["graph_id", "part", "n", "p", "step", "likelihood", "pairs", "edges"])

    from ..plans.lineage import cut

    made = windows(obs, window_size, tasks).groupBy("sample", "win").applyInPandas(prepare, MADE)
    made = cut(made.withColumn("graph_id", F.col("win") * 2 + F.col("sample") - 1))
    parts = made.select("graph_id", F.explode("parts").alias("x")).select("graph_id", "x.*").repartition(tasks, "graph_id", "part")
    paths = cut(parts.mapInPandas(solve, "graph_id long, part int, n int, p int, step int, likelihood double, pairs int, edges array<struct<src int, dst int, weight double>>"))
    sums = paths.groupBy("graph_id", "step").agg(F.max("n").alias("n"), F.max("p").alias("p"), F.sum("likelihood").alias("l"), F.sum("pairs").alias("e"))
    best = sums.groupBy("graph_id").agg(F.min_by("step", F.struct(criterion(F.col("l"), F.col("n"), F.col("p"), F.col("e"), beta, F.log), "step")).alias("step"))
    graphs = made.select("graph_id", "sample", F.lit(False).alias("directed"))
    nodes = made.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.node_id", "n.label", "n.attr")
    edges = paths.join(best, ["graph_id", "step"]).select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.src", "e.dst", "e.weight", F.lit(None).cast("string").alias("edge_label"))
    gs = GraphSet(graphs, nodes, edges)
    return gs.with_degree_labels() if set_labels == "degree" else gs.with_labels(set_labels) if isinstance(set_labels, dict) else gs


def tasks_for(spark, pieces: int) -> int:
    """Tasks for so many pieces of work that are small in bytes: hash partitions hold unequal numbers of them, so many more than cores, and no task of more than 512 or so."""
    return max(1, min(pieces, max(16 * spark.sparkContext.defaultParallelism, pieces // 512)))


def solved(row, alphas: list[float], beta: float, solver: dict) -> list[tuple]:
    """A row for each penalty of one part of a window: its share of the likelihood, its edges. The only part of its window tells which penalty wins by itself and gives that row alone."""
    c = np.asarray(row.cols)
    s, moment = (np.asarray(v, float).reshape(len(c), len(c)) for v in (row.s, row.moment))
    out = [None] * len(alphas)
    for k, cov, theta in lasso.path(s, alphas, **solver):
        at = np.argwhere(np.triu(np.abs(theta) >= ZERO, 1))
        out[k] = (row.graph_id, row.part, row.n, row.p, k, part_likelihood(cov, moment, row.n, row.least), len(at), (at, theta))
    if row.lone:
        out = [min(out, key=lambda r: (criterion(r[5], r[2], r[3], r[6], beta), r[4]))]
    edges = lambda at, theta: [{"src": i, "dst": j, "weight": v} for i, j, v in zip(*c[at.T].tolist(), theta[at[:, 0], at[:, 1]].tolist(), strict=True)]
    return [(*r[:-1], edges(*r[-1])) for r in out]


def two_column_precision(obs: DataFrame, size: int, alpha: float) -> DataFrame:
    """(sample, win, weight): the lasso's off-diagonal precision for two columns, in closed form: the covariance shrinks to sign(s) max(|s| - alpha, 0)."""
    v = windows(obs, size).select("sample", "win", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    s = v.groupBy("sample", "win").agg(F.var_pop("a").alias("aa"), F.var_pop("b").alias("bb"), F.covar_pop("a", "b").alias("ab"))
    w = F.signum("ab") * F.greatest(F.abs("ab") - alpha, F.lit(0.0))
    return s.withColumn("w", w).select("sample", "win", (-F.col("w") / (F.col("aa") * F.col("bb") - F.col("w") * F.col("w"))).alias("weight"))
