"""The test as one call: kernel by name, estimators by name, resampling, p-values. Nothing is kept between calls."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GraphSet
from ..operators import blocked, external, gram, mmd, tangent, walks, wl
from ..sources.tables import gram_from_matrix
from .lineage import cut

log = logging.getLogger("graphduo")
RANDOM_WALKS = ("RW_ARKU_plus", "RW_ARKU", "RW_ARKU_edge", "RW_ARKL")
#: Walks whose Gram matrix is made in tiles where all that is asked of it works on tiles.
TILED = ("RW_ARKU_plus", "RW_ARKU_edge")
KERNELS = (*RANDOM_WALKS, "GNTK", "WWL", "DK")


def _need(options: dict, *names: str) -> list:
    missing = [n for n in names if n not in options]
    if missing:
        raise KeyError(f"missing: {', '.join(missing)}")
    return [options[n] for n in names]


def kernel_matrix(gs: GraphSet | None, kernel, **o) -> DataFrame:
    """The Gram table of a kernel.

    kernel: one of KERNELS, a list of settings (operators.external), a table (i, j, k) or a square array.
    Random walks: c, and r for rank r (r=None: the series of `terms` steps at full rank), normalize, check_psd=True, use_attr;
    RW_ARKU_edge: unique_edge_labels, label_mode; RW_ARKL: unique_node_labels (None: those found). GNTK: num_layers, jk, scale,
    num_mlp_layers, degree_as_tag, use_attr. WWL: discount, h, sinkhorn, sinkhorn_lambda. DK: type, wl_it, opt_type ('word2vec'),
    vector_size, window, min_count. All: normalize.
    """
    if isinstance(kernel, DataFrame):
        return kernel
    if isinstance(kernel, (np.ndarray, tuple)):
        return gram_from_matrix(SparkSession.active(), kernel)
    gs.validate()
    if isinstance(kernel, list):
        k = external.by_name(gs, kernel)
    elif kernel in RANDOM_WALKS:
        gs, c, r, labels, mode = _walk(gs, kernel, o)
        if r is None:
            k = walks.series(gs, kernel, c, o.get("terms", 6), o.get("use_attr", False), labels, mode)
        else:
            k = walks.spectral(gs, kernel, c, r, o.get("use_attr", False), labels, mode)
    elif kernel == "GNTK":
        layers, jk, scale = _need(o, "num_layers", "jk", "scale")
        k = tangent.kernel(gs, layers, o.get("num_mlp_layers"), jk, scale, o.get("degree_as_tag", True), o.get("use_attr", False))
    elif kernel == "WWL":
        discount, h = _need(o, "discount", "h")
        k = wl.wasserstein(gs.validate(label=True), discount, h, o.get("sinkhorn", False), o.get("sinkhorn_lambda", 1.0))
    elif kernel == "DK":
        (kind,) = _need(o, "type")
        if kind not in ("wl", "sp"):
            raise ValueError(f"type must be 'wl' or 'sp', not {kind!r}")
        if kind == "sp":
            gs.validate(label=True)
        if o.get("opt_type") == "word2vec":
            k = wl.deep_word2vec(gs, kind, o.get("wl_it", 2), o.get("vector_size", 2), o.get("window", 2), o.get("min_count", 0))
        else:
            k = wl.deep_wl(gs, o.get("wl_it", 2)) if kind == "wl" else wl.deep_sp(gs)
    else:
        raise ValueError(f"kernel must be one of {KERNELS}, a list of settings or a matrix, not {kernel!r}")
    if o.get("normalize", False):
        k = gram.normalised(k)
    if kernel in RANDOM_WALKS and o.get("check_psd", True):
        k = gram.check_psd(cut(k))
    return k


def _walk(gs: GraphSet, kernel: str, o: dict) -> tuple[GraphSet, float, int | None, list[str] | None, str]:
    c, r = _need(o, "c", "r")
    if o.get("edge_attr", "weight") is None:
        gs = gs.unweighted()
    labels = None
    if kernel == "RW_ARKU_edge":
        (labels,) = _need(o, "unique_edge_labels")
    if kernel == "RW_ARKL":
        (labels,) = _need(o, "unique_node_labels")
    return gs, c, r, labels, o.get("label_mode", "exclude")


def kernel_tiles(gs: GraphSet, kernel: str, **o) -> blocked.Tiles:
    """kernel_matrix of a walk of TILED at rank r, in tiles."""
    gs.validate()
    gs, c, r, labels, mode = _walk(gs, kernel, o)
    t = walks.spectral_tiles(gs, kernel, c, r, o.get("use_attr", False), labels, mode)
    if o.get("check_psd", True):
        gram.check_tiles(t, blocked.largest(t))
    return t


def columns_in_use(gs: GraphSet, kernel, options: dict) -> list[str]:
    """Of edges and nodes, the columns that a kernel's values depend on."""
    walk = kernel in RANDOM_WALKS if isinstance(kernel, str) else False
    out = ["edges.weight"] if walk and options.get("edge_attr", "weight") is not None else []
    out += ["edges.edge_label"] if isinstance(kernel, str) and kernel == "RW_ARKU_edge" else []
    labelled = isinstance(kernel, list) or isinstance(kernel, str) and kernel in ("RW_ARKL", "WWL", "DK")
    out += ["nodes.label"] if labelled else []
    out += ["nodes.attr"] if options.get("use_attr") else []
    return out or ["edges.src", "edges.dst"]


def two_sample_test(gs: GraphSet | None, kernel, estimators: str | list[str] | dict[str, Callable], B: int = 1000, bootstrap_method: str | Callable = "PermutationScheme", check_symmetry: bool = False, Q: int | None = None, seed: int = 0, n1: int | None = None, compat: bool = False, **options) -> DataFrame:
    """(estimator, statistic, p_value, n1, n2, B): one row per estimator, all on the same resamples.

    estimators: names of mmd.ESTIMATORS, or a dict of functions f(K, n1, rng). MONK_EST needs an odd Q. bootstrap_method:
    PermutationScheme, BootstrapScheme or a function (n, rng) -> indices. With a precomputed
    matrix and no graphs, n1 tells the size of the first sample. p = share of the null at or above the
    observed value. MMD_l by itself has the kernel computed for the pairs of graphs that it reads, not for all; the
    eigenvalue check, which needs all, is left out then. Named estimators on the two schemes work on the Gram table and its tiles; functions of a whole
    matrix get one, of mmd.WHOLE graphs at most.
    """
    named = [estimators] if isinstance(estimators, str) else estimators
    scheme = {"PermutationScheme": "permutation", "BootstrapScheme": "bootstrap"}.get(bootstrap_method, bootstrap_method) if isinstance(bootstrap_method, str) else bootstrap_method
    if isinstance(scheme, str) and scheme not in ("permutation", "bootstrap"):
        raise ValueError(f"no resampling scheme {bootstrap_method!r}")
    for name in named if not isinstance(named, dict) else ():
        if name not in mmd.ESTIMATORS:
            raise ValueError(f"estimator must be one of {mmd.ESTIMATORS}, not {name!r}")
        if name == "MONK_EST" and Q is None:
            raise ValueError("MONK_EST needs Q")
        if name == "MONK_EST" and Q % 2 == 0:
            raise ValueError("Q must be odd")
    log.info("kernel %s, estimators %s, options %s", kernel if isinstance(kernel, str) else type(kernel).__name__, list(named), options)
    spark = gs.graphs.sparkSession if gs is not None else SparkSession.active()
    if gs is not None:
        log.info("columns in use: %s", ", ".join(columns_in_use(gs, kernel, options)))
    if check_symmetry and isinstance(kernel, (np.ndarray, tuple)) and not np.allclose(kernel, np.asarray(kernel).T):
        raise ValueError("the Gram matrix is not symmetric")
    try:  # progress in the UI
        spark.sparkContext.setJobDescription(f"kernel matrix: {kernel if isinstance(kernel, str) else 'given'}")
        if gs is not None:
            n1 = gs.sizes()[0]
        if list(named) == ["MMD_l"] and gs is not None and isinstance(kernel, (str, list)) and isinstance(scheme, str):
            if gs.sizes()[1] != n1:
                raise ValueError(f"MMD_l needs samples of the same size, not {n1} and {gs.sizes()[1]}")
            near = mmd.wanted_pairs(cut(gs.pooled()), B, seed, scheme)
            if options.get("normalize", False):
                near = near.unionAll(gs.pooled().select(F.col("ord").alias("i"), F.col("ord").alias("j"))).distinct()
            gs, options = replace(gs, pairs=cut(near)), {"check_psd": False, **options}
        tiled = gs is not None and gs.pairs is None and isinstance(kernel, str) and kernel in TILED and options.get("r") is not None and not options.get("normalize", False) and isinstance(scheme, str) and not isinstance(named, dict) and "MMD_l" not in named
        k = kernel_tiles(gs, kernel, **options) if tiled else cut(kernel_matrix(gs, kernel, **options))
        n = sum(gs.sizes()) if gs is not None else int(k.agg(F.max("j")).first()[0] or 0) + 1
        if n1 is None or not 0 < n1 < n:
            raise ValueError("n1 must tell the size of the first sample")
        pooled = cut(gs.pooled() if gs is not None else spark.range(n).select(F.col("id").alias("graph_id"), F.when(F.col("id") < n1, 1).otherwise(2).alias("sample"), F.lit(False).alias("directed"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") < n1, F.col("id")).otherwise(F.col("id") - n1).cast("int").alias("pos")))
        spark.sparkContext.setJobDescription(f"null distribution: {B} resamples")
        if isinstance(named, dict) or callable(scheme):
            found = whole_matrix(spark, k, pooled, n, n1, named, B, seed, scheme, Q, compat)
        else:
            found = by_tiles(spark, k, pooled, n, n1, named, B, seed, scheme, Q, compat)
    finally:
        spark.sparkContext.setJobDescription(None)
    top = mmd.largest_entry(k)  # of means of entries alone, not of own functions and the witness's gap
    rows = [(name, value, mmd.share_at_or_above(null, value, 0.0 if isinstance(named, dict) or name == "MONK_EST" else top), n1, n - n1, B) for name, value, null in found]
    return spark.createDataFrame(rows, "estimator string, statistic double, p_value double, n1 int, n2 int, B int")


def by_tiles(spark: SparkSession, k: DataFrame | blocked.Tiles, pooled: DataFrame, n: int, n1: int, named: list[str], B: int, seed: int, scheme: str, Q: int | None, compat: bool) -> list[tuple[str, float, np.ndarray]]:
    """(estimator, statistic, its B values under the null): MMD_u and MMD_b share one pass over the tiles, MMD_l reads the entries it needs, MONK_EST works on a factor."""
    numbers = lambda df: df.orderBy("b").toPandas()["statistic"].to_numpy()  # noqa: E731  B numbers
    sums, own, out = None, None, []
    for name in named:
        if name == "MONK_EST":
            f = blocked.factor(k if isinstance(k, blocked.Tiles) else blocked.tiles(k, n))
            ids = [r["graph_id"] for r in pooled.orderBy("ord").select("graph_id").collect()]  # n ids, beside n x rank numbers
            seen = mmd.block_descent(f, np.arange(n), n1, Q, np.random.default_rng([seed, 0]))
            out.append((name, seen, numbers(mmd.null_median_of_means(spark, f, ids, n1, Q, B, seed, scheme))))
            continue
        if isinstance(k, blocked.Tiles):
            own = cut(blocked.resample_sums(k, pooled.select(F.lit(1).alias("b"), "ord", F.col("sample").alias("a")), 1)) if own is None else own
            seen = float(own.select(mmd.formula(name, n1, n - n1, compat).alias("statistic")).first()["statistic"])
        else:
            seen = float(mmd.estimate(k, pooled, name, compat).first()["statistic"])
        if name == "MMD_l":
            out.append((name, seen, numbers(mmd.null_linear(k, pooled, B, seed, scheme))))
            continue
        sums = cut(mmd.null_sums(k, pooled, B, seed, scheme)) if sums is None else sums
        out.append((name, seen, numbers(sums.select("b", mmd.formula(name, n1, n - n1, compat).alias("statistic")))))
    return out


def whole_matrix(spark: SparkSession, k: DataFrame, pooled: DataFrame, n: int, n1: int, named, B: int, seed: int, scheme: str | Callable, Q: int | None, compat: bool) -> list[tuple[str, float, np.ndarray]]:
    """by_tiles for functions of a whole matrix, which goes to the driver and each worker."""
    if n > mmd.WHOLE:
        raise ValueError(f"own statistics and resamplers get the whole matrix: at most {mmd.WHOLE} graphs, not {n}")
    named_ = {name: (lambda m, size, rng: mmd.median_of_means(m, size, Q, rng)) if name == "MONK_EST" else (lambda m, size, rng, e=name: mmd.dense_stat(m, size, e, compat)) for name in named} if not isinstance(named, dict) else named
    m, ids = gram.dense(k), [r["graph_id"] for r in pooled.orderBy("ord").select("graph_id").collect()]
    null = mmd.dense_null(spark, m, n1, named_, B, seed, scheme, ids=ids).toPandas()
    return [(name, float(f(m, n1, np.random.default_rng([seed, 0]))), null.loc[null["estimator"] == name, "statistic"].to_numpy()) for name, f in named_.items()]
