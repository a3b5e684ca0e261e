"""Maximum mean discrepancy between the two samples: estimators, resampling, p-values."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocked

ESTIMATORS = ("MMD_u", "MMD_b", "MMD_l", "MONK_EST")
#: Graphs up to which statistics and resamplers that are functions of a whole matrix get one (200 MB).
WHOLE = 5000
#: Statistics that differ by less than this share of the largest tie: rounding, not a difference.
TIE = 1e-9
#: Statistics are differences of means of entries: by this share of the largest entry, rounding may tell them apart.
NOISE = 1e-12


def pair_sums(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of k for pairs (a, b, k, same: a graph with itself) where a, b tell the samples; one row per `by`."""
    k, twice = F.col("k"), F.when(F.col("same"), 1.0).otherwise(2.0)
    in_ = lambda s: (F.col("a") == s) & (F.col("b") == s)
    return pairs.groupBy(*by).agg(
        F.sum(F.when(in_(1), k * twice).otherwise(0.0)).alias("xx"), F.sum(F.when(in_(2), k * twice).otherwise(0.0)).alias("yy"),
        F.sum(F.when(in_(1) & F.col("same"), k).otherwise(0.0)).alias("dx"), F.sum(F.when(in_(2) & F.col("same"), k).otherwise(0.0)).alias("dy"),
        F.sum(F.when(F.col("a") != F.col("b"), k).otherwise(0.0)).alias("xy"),
    )


def formula(estimator: str, n1: int, n2: int, compat: bool = False, sums: Sequence | None = None) -> Column:
    """The estimate from the columns of pair_sums, or from such sums as numbers or arrays. MMD_b is the V-statistic; compat keeps a published variant whose denominators differ when n1 is not n2."""
    xx, yy, dx, dy, xy = sums or [F.col(c) for c in ("xx", "yy", "dx", "dy", "xy")]
    if estimator == "MMD_u":
        return (xx - dx) / (n1 * (n1 - 1)) + (yy - dy) / (n2 * (n2 - 1)) - 2 * xy / (n1 * n2)
    if estimator == "MMD_b":
        return xx / n1**2 + yy / (n1 * n2) - 2 * xy / n2**2 if compat else xx / n1**2 + yy / n2**2 - 2 * xy / (n1 * n2)
    raise ValueError(f"no pair formula for {estimator!r}")


def _check_size(k: DataFrame, n1: int, n2: int) -> None:
    top = k.agg(F.max("j")).first()[0]
    if top is None or top + 1 != n1 + n2:
        raise ValueError(f"the Gram matrix is of {0 if top is None else top + 1} graphs, the samples have {n1} + {n2}")


def estimate(k: DataFrame, pooled: DataFrame, estimator: str, compat: bool = False) -> DataFrame:
    """One row (estimator, statistic, n1, n2) by conditional sums over the Gram table."""
    sizes = {r["sample"]: r["n"] for r in pooled.groupBy("sample").agg(F.count("*").alias("n")).collect()}
    n1, n2 = sizes.get(1, 0), sizes.get(2, 0)
    if estimator == "MMD_l":
        return linear(k, pooled, n1, n2)
    _check_size(k, n1, n2)
    side = lambda c, s: pooled.select(F.col("ord").alias(c), F.col("sample").alias(s))
    pairs = k.join(side("i", "a"), "i").join(side("j", "b"), "j").withColumn("same", F.col("i") == F.col("j"))
    return pair_sums(pairs, []).select(F.lit(estimator).alias("estimator"), formula(estimator, n1, n2, compat).alias("statistic"), F.lit(n1).alias("n1"), F.lit(n2).alias("n2"))


def linear(k: DataFrame, pooled: DataFrame, n1: int, n2: int) -> DataFrame:
    """The linear-time estimate: the mean of Kxx + Kyy - Kxy - Kyx over disjoint neighbours (2i, 2i+1); an odd last graph is left out."""
    if n1 != n2:
        raise ValueError(f"MMD_l needs samples of the same size, not {n1} and {n2}")
    even = n1 - n1 % 2
    side = lambda c, s, p: pooled.select(F.col("ord").alias(c), F.col("sample").alias(s), F.col("pos").alias(p))
    near = k.join(side("i", "a", "p"), "i").join(side("j", "b", "q"), "j").where(f"p < {even} and q < {even} and floor(p / 2) = floor(q / 2) and p <> q")
    total = F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(-F.col("k")))
    return near.agg(total.alias("s")).select(F.lit("MMD_l").alias("estimator"), (F.col("s") / (even / 2)).alias("statistic"), F.lit(n1).alias("n1"), F.lit(n2).alias("n2"))


def over_cores(pooled: DataFrame) -> DataFrame:
    """pooled, which its numbering leaves in one partition, dealt to all cores before each graph is repeated for every resample."""
    return pooled.repartition(4 * pooled.sparkSession.sparkContext.defaultParallelism, "ord")


def permutations(pooled: DataFrame, b: int, seed: int) -> DataFrame:
    """(b, ord, a): samples dealt anew without replacement, in the order of md5(seed | b | graph_id)."""
    n1 = pooled.where("sample = 1").count()
    rows = over_cores(pooled).select("ord", "graph_id", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("graph_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("b").orderBy(key, "graph_id"))
    return rows.select("b", "ord", F.when(place <= n1, 1).otherwise(2).alias("a"))


def bootstraps(pooled: DataFrame, b: int, seed: int) -> DataFrame:
    """(b, slot, ord, a): n slots, each a graph drawn with replacement by a hash; the first n1 slots are sample 1."""
    n, n1 = pooled.count(), pooled.where("sample = 1").count()
    slots = over_cores(pooled).select(F.col("ord").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.col("b").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % n
    return slots.select("b", "slot", draw.cast("int").alias("ord"), F.when(F.col("slot") < n1, 1).otherwise(2).alias("a"))


def null_sums(k: DataFrame | blocked.Tiles, pooled: DataFrame, b: int, seed: int, scheme: str = "permutation") -> DataFrame:
    """(b, xx, yy, dx, dy, xy): pair_sums for each of b resamples, which are dealt by hashes."""
    if scheme not in ("permutation", "bootstrap"):
        raise ValueError("scheme must be 'permutation' or 'bootstrap'")
    d = permutations(pooled, b, seed) if scheme == "permutation" else bootstraps(pooled, b, seed)
    return blocked.resample_sums(k if isinstance(k, blocked.Tiles) else blocked.tiles(k, pooled.count()), d, b)


def null_distribution(k: DataFrame, pooled: DataFrame, estimator: str, b: int, seed: int, scheme: str = "permutation", compat: bool = False) -> DataFrame:
    """(b, statistic): the estimate for each of b resamples. For any number of graphs the matrix stays in tiles, each of which meets the counts of all resamples once."""
    n, n1 = pooled.count(), pooled.where("sample = 1").count()
    if estimator == "MMD_l":
        return null_linear(k, pooled, b, seed, scheme)
    return null_sums(k, pooled, b, seed, scheme).select("b", formula(estimator, n1, n - n1, compat).alias("statistic"))


def null_linear(k: DataFrame, pooled: DataFrame, b: int, seed: int, scheme: str = "permutation") -> DataFrame:
    """(b, statistic) of MMD_l: only the 2n entries that a resample needs, met by a join of the Gram table with the neighbours of all resamples."""
    return neighbours(pooled, b, seed, scheme).join(k, ["i", "j"]).groupBy("b").agg((F.sum(F.col("w") * F.col("k")) / F.max("m")).alias("statistic"))


def wanted_pairs(pooled: DataFrame, b: int, seed: int, scheme: str = "permutation") -> DataFrame:
    """(i, j): the entries that MMD_l reads, of the samples as they are and of all resamples: some 2n (b + 1) of the n^2 / 2."""
    near = neighbours(pooled, b, seed, scheme).select("i", "j")
    return near.unionAll(placed_neighbours(pooled.select(F.lit(0).alias("b"), "ord", F.col("sample").alias("a"), "pos"), pooled.where("sample = 1").count()).select("i", "j")).distinct()


def neighbours(pooled: DataFrame, b: int, seed: int, scheme: str) -> DataFrame:
    """(b, i, j, w, m): pairs of graphs in neighbouring places of each resample, with their sign, and how many places of two there are."""
    n, n1 = pooled.count(), pooled.where("sample = 1").count()
    if n != 2 * n1:
        raise ValueError(f"MMD_l needs samples of the same size, not {n1} and {n - n1}")
    if scheme == "permutation":
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("graph_id").cast("string")))
        dealt = pooled.select("ord", "graph_id", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))
        place = dealt.select("b", "ord", (F.row_number().over(Window.partitionBy("b").orderBy(key, "graph_id")) - 1).alias("slot"))
    else:
        place = bootstraps(pooled, b, seed).select("b", "ord", "slot")
    return placed_neighbours(place.select("b", "ord", F.when(F.col("slot") < n1, 1).otherwise(2).alias("a"), (F.col("slot") % n1).alias("pos")), n1)


def placed_neighbours(at: DataFrame, n1: int) -> DataFrame:
    """neighbours of graphs placed as (b, ord, a, pos)."""
    group = at.where(F.col("pos") < n1 - n1 % 2).groupBy("b", F.floor(F.col("pos") / 2).alias("t")).agg(*[F.max(F.when((F.col("a") == s) & (F.col("pos") % 2 == o), F.col("ord"))).alias(f"{name}{o}") for s, name in ((1, "x"), (2, "y")) for o in (0, 1)])
    pair = lambda u, v, sign: F.struct(F.least(u, v).alias("i"), F.greatest(u, v).alias("j"), F.lit(sign).alias("w"))
    return group.select("b", F.explode(F.array(pair("x0", "x1", 1.0), pair("y0", "y1", 1.0), pair("x0", "y1", -1.0), pair("x1", "y0", -1.0))).alias("e")).select("b", "e.i", "e.j", "e.w", F.lit(n1 // 2).alias("m"))


def largest_entry(k: DataFrame | blocked.Tiles) -> float:
    return blocked.largest(k) if isinstance(k, blocked.Tiles) else float(k.agg(F.max(F.abs("k"))).first()[0] or 0.0)


def p_value(null: DataFrame, observed: DataFrame, top: float = 0.0) -> DataFrame:
    """(p_value): the share of the null at or above the observed value.

    A resample that repeats the split must tie though its sums were added in another order: values within TIE of the largest
    absolute value do, and those within NOISE of `top`, the kernel's largest entry, as of a kernel that does not tell the graphs
    apart all statistics are rounding. Both bounds go with the scale of the kernel, so p does not depend on that.
    """
    at = observed.select(F.col("statistic").alias("o"))
    least = null.agg(F.max(F.abs("statistic")).alias("top")).join(F.broadcast(at)).select((F.col("o") - F.greatest(TIE * F.greatest(F.abs("o"), F.coalesce("top", F.lit(0.0))), F.lit(NOISE * top))).alias("least"))  # one row each
    return null.select("statistic").join(F.broadcast(least)).agg(F.avg((F.col("statistic") >= F.col("least")).cast("double")).alias("p_value"))


def share_at_or_above(null: np.ndarray, observed: float, top: float = 0.0) -> float:
    """p_value of arrays."""
    return float((null >= observed - max(TIE * max(abs(observed), np.abs(null).max(initial=0.0)), NOISE * top)).mean())


# --- the same on a dense matrix: one matmul per batch of resamples -----------------------------------


def dense_stat(k: np.ndarray, n1: int, estimator: str, compat: bool = False) -> float:
    """An estimate of a matrix whose first n1 rows are sample 1."""
    n2 = len(k) - n1
    if n1 < 1 or n2 < 1:
        raise ValueError("both samples need rows")
    x, y, c = k[:n1, :n1], k[n1:, n1:], k[:n1, n1:]
    if estimator == "MMD_u":
        return (x.sum() - np.trace(x)) / (n1 * (n1 - 1)) + (y.sum() - np.trace(y)) / (n2 * (n2 - 1)) - 2 * c.sum() / (n1 * n2)
    if estimator == "MMD_b":
        return x.sum() / n1**2 + y.sum() / (n1 * n2) - 2 * c.sum() / n2**2 if compat else x.mean() + y.mean() - 2 * c.mean()
    if estimator == "MMD_l":
        if n1 != n2:
            raise ValueError(f"MMD_l needs samples of the same size, not {n1} and {n2}")
        e = np.arange(0, n1 - n1 % 2, 2)
        return float((x[e, e + 1] + y[e, e + 1] - c[e, e + 1] - c[e + 1, e]).mean())
    raise ValueError(f"estimator must be one of {ESTIMATORS}, not {estimator!r}")


def median_of_means(k: np.ndarray, n1: int, q: int, rng: np.random.Generator, rounds: int = 100, beta: float = 0.001) -> float:
    """MONK (Lerasle et al. 2019): the median over q blocks of the witness gap, the witness improved by block coordinate steps on the median block, whose
    norm is that of the matrix with its negative eigenvalues clipped."""
    lam, u = np.linalg.eigh(k)
    return block_descent(blocked.Factor(np.eye(len(k)), k, u * np.sqrt(np.maximum(lam, 0))), np.arange(len(k)), n1, q, rng, rounds, beta)


def block_descent(f: blocked.Factor, order: np.ndarray, n1: int, q: int, rng: np.random.Generator, rounds: int = 100, beta: float = 0.001) -> float:
    """median_of_means of the graphs in an order, the first n1 being sample 1, on a factor: a step costs n x rank."""
    n2 = len(order) - n1
    if q % 2 == 0:
        raise ValueError("Q must be odd")
    if q < 1 or q > min(n1, n2):
        raise ValueError("Q must be from 1 to the size of the smaller sample")
    basis, plus = f.basis[order], f.plus[order]
    witness = basis.sum(axis=0)  # the witness is kept by its products with the basis
    witness /= np.sqrt(max(witness @ f.core @ witness, 1e-300))
    gap = 0.0
    for t in range(rounds):
        first = np.array_split(rng.permutation(n1), q)
        second = first if n1 == n2 else np.array_split(rng.permutation(n2), q)
        value = basis @ (f.core @ witness)
        gaps = [value[a].mean() - value[n1 + b].mean() for a, b in zip(first, second, strict=True)]
        mid = int(np.argsort(gaps, kind="stable")[q // 2])
        gap = float(gaps[mid])
        a, b = first[mid], n1 + second[mid]
        norm = np.linalg.norm(plus[a].sum(axis=0) - plus[b].sum(axis=0))
        witness += ((basis[a].sum(axis=0) - basis[b].sum(axis=0)) / max(norm, 1e-150) - witness) / (1 + beta * t)
    return gap


def null_median_of_means(spark, f: blocked.Factor, ids: Sequence, n1: int, q: int, b: int, seed: int, scheme: str = "permutation") -> DataFrame:
    """(b, statistic): block_descent for each of b resamples, the factor sent to each worker (at most blocked.VECTORS bytes a part)."""
    sent, ids = spark.sparkContext.broadcast(f), list(ids)

    def run(it):
        for pdf in it:
            out = []
            for r in map(int, pdf["id"]):
                order = hash_order(seed, r, ids) if scheme == "permutation" else hash_draws(seed, r, len(ids))
                out.append((r, block_descent(sent.value, order, n1, q, np.random.default_rng([seed, r]))))
            yield pd.DataFrame(out, columns=["b", "statistic"]).astype({"b": "int32", "statistic": "float64"})

    return spark.range(1, b + 1, 1, min(b, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "b int, statistic double")


def hash_order(seed: int, b: int, ids: Sequence) -> np.ndarray:
    """Resample b of `permutations` as an order of the graphs: the first n1 are sample 1."""
    key = [hashlib.md5(f"{seed}|{b}|{i}".encode()).hexdigest() for i in ids]
    return np.array(sorted(range(len(ids)), key=lambda k: (key[k], ids[k])))


def hash_draws(seed: int, b: int, n: int) -> np.ndarray:
    """Resample b of `bootstraps`: the graph of each slot."""
    return np.array([int(hashlib.md5(f"{seed}|{b}|{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)])


def dense_null(spark, k: np.ndarray, n1: int, stats: dict[str, Callable[[np.ndarray, int, np.random.Generator], float]], b: int, seed: int, scheme: str | Callable = "permutation", parts: int | None = None, ids: Sequence | None = None) -> DataFrame:
    """(b, estimator, statistic): any statistics on shared resamples; the matrix goes to each worker once (N x N, which `gram.dense` already held on the driver).

    scheme: 'permutation', 'bootstrap' (both dealt by hashes, as in null_distribution; ids: the graphs' ids, else their places) or a function (n, rng) -> indices.
    """
    shared = spark.sparkContext.broadcast(np.asarray(k, float))
    ids = list(range(len(k))) if ids is None else list(ids)

    def run(it):
        kk = shared.value
        n = len(kk)
        for pdf in it:
            rows = []
            for r in map(int, pdf["id"]):
                rng = np.random.default_rng([seed, r])
                idx = scheme(n, rng) if callable(scheme) else hash_order(seed, r, ids) if scheme == "permutation" else hash_draws(seed, r, n)
                sub = kk[np.ix_(idx, idx)]
                rows += [(r, name, float(f(sub, n1, rng))) for name, f in stats.items()]
            yield pd.DataFrame(rows, columns=["b", "estimator", "statistic"])

    parts = parts or spark.sparkContext.defaultParallelism
    return spark.range(1, b + 1, 1, min(parts, b)).mapInPandas(run, "b long, estimator string, statistic double")
