"""Gram matrices as tables (i, j, k) with i <= j: sums of products, normalising, checks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Graphs in a block of the pair grid; for kernels that hold all node pairs of two blocks at a time, fewer.
BLOCK, SMALL_BLOCK = 64, 16
#: Rounding of the entries of a Gram table, as a share of the largest: it moves an eigenvalue by up to n times that.
ROUNDING = 16 * float(np.finfo(float).eps)
#: Graphs of one feature on the left side of a task.
TOGETHER = 256
#: Binary digits of a double, less one that the rounding of many terms may carry into; the least and the largest unit that terms are cut at.
DIGITS, UNITS = 52, (2.0**-1000, 2.0**972)


def all_pairs(pooled: DataFrame) -> DataFrame:
    """(i, j) of the upper triangle. A Gram matrix has every pair: this is its size, not an intermediate blow-up."""
    n = pooled.agg(F.max("ord")).first()[0]
    n = -1 if n is None else n
    rows = pooled.select(F.col("ord").alias("i"))
    return rows.select("i", F.explode(F.sequence(F.col("i"), F.lit(n))).alias("j"))


def meeting(f: DataFrame, *values: str) -> DataFrame:
    """(i, j, a, b, values...) for i <= j of all pairs of rows (ord, feature, v, values...) of a feature.

    A feature of n graphs makes n^2 / 2 rows: it is dealt to a task for each TOGETHER graphs on the left
    side, and the right side goes to all of these, so one that every graph has is no one task's work.
    """
    tasks = F.ceil(F.count("*").over(Window.partitionBy("feature")) / TOGETHER).cast("int")
    spread = f.withColumn("tasks", tasks)
    a = spread.select(F.col("ord").alias("i"), "feature", F.pmod(F.col("ord"), F.col("tasks")).alias("task"), F.col("v").alias("a"), *values)
    b = spread.select(F.col("ord").alias("j"), "feature", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("v").alias("b"))
    return a.join(b, ["feature", "task"]).where("i <= j")


def steady_sum(x: Column, bound: Column) -> Column:
    """The sum of x, rounded about once and not at every term, in whatever order the terms come; the absolute values of a group add up to `bound` at most.

    Each term is cut at the last digit of the bound: the multiples of that unit add up exactly, what is left is added up by itself.
    """
    unit = F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(bound)) - DIGITS), F.lit(UNITS[0])), F.lit(UNITS[1]))  # a bound of 0 has no logarithm
    whole = F.rint(x / unit) * unit
    return F.sum(whole) + F.sum(F.when(x == whole, 0.0).otherwise(x - whole))


def wanted(f: DataFrame, pairs: DataFrame | None, *values: str) -> DataFrame:
    """meeting, or of these rows only those of the wanted pairs: features meet by graph, and no row of another pair is made."""
    if pairs is None:
        return meeting(f, *values)
    a = f.select(F.col("ord").alias("i"), "feature", F.col("v").alias("a"), *values)
    b = f.select(F.col("ord").alias("j"), "feature", F.col("v").alias("b"))
    return pairs.select("i", "j").join(a, "i").join(b, ["j", "feature"])


def dot(features: DataFrame, pooled: DataFrame, how=lambda a, b: F.sum(a * b), pairs: DataFrame | None = None) -> DataFrame:
    """Sum over common features of f(v_i, v_j), for features (graph_id, feature, v), of all pairs or of those wanted; pairs without any get 0."""
    f = features.join(pooled.select("graph_id", "ord"), "graph_id").select("ord", "feature", "v")
    k = wanted(f, pairs).groupBy("i", "j").agg(how(F.col("a"), F.col("b")).alias("k"))
    return (all_pairs(pooled) if pairs is None else pairs.select("i", "j")).join(k, ["i", "j"], "left").select("i", "j", F.coalesce("k", F.lit(0.0)).alias("k"))


def normalised(gram: DataFrame) -> DataFrame:
    """k_ij / sqrt(k_ii k_jj); 0 where a diagonal entry is not positive."""
    d = gram.where("i = j").select("i", F.col("k").alias("d"))
    both = gram.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    return both.select("i", "j", F.when((F.col("d") > 0) & (F.col("e") > 0), F.col("k") / F.sqrt(F.col("d") * F.col("e"))).otherwise(0.0).alias("k"))


def symmetrised(gram: DataFrame) -> DataFrame:
    """Both triangles."""
    return gram.unionAll(gram.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))


def asymmetric(full: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Entries of a full matrix that differ from their mirror image by more than atol + rtol * |mirror|, or have none."""
    t = full.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("k").alias("m"))
    return full.join(t, ["i", "j"], "left").where(F.col("m").isNull() | (F.abs(F.col("k") - F.col("m")) > atol + rtol * F.abs("m")))


def dense(gram: DataFrame) -> np.ndarray:
    """The matrix on the driver: N x N numbers, which the caller bounds (eigenvalues and resampling need it whole)."""
    pdf = gram.toPandas()
    n = int(pdf[["i", "j"]].to_numpy().max()) + 1 if len(pdf) else 0
    k = np.zeros((n, n))
    k[pdf["i"], pdf["j"]] = pdf["k"]
    k[pdf["j"], pdf["i"]] = pdf["k"]
    return k


def check_psd(gram: DataFrame, least: float = -1e-11) -> DataFrame:
    """gram, or ValueError if an eigenvalue is below `least`: by block Lanczos on the tiles of the matrix, which no machine holds whole.

    Where the entries are so large that their rounding alone reaches beyond `least`, the bound is what rounding can do.
    """
    from . import blocked

    n, top = gram.agg(F.max("j"), F.max(F.abs("k"))).first()
    if n is None:
        return gram
    check_tiles(blocked.tiles(gram, int(n) + 1), top or 0.0, least)
    return gram


def check_tiles(t, top: float, least: float = -1e-11) -> None:
    """check_psd of a matrix in tiles whose largest entry is top."""
    from . import blocked

    bound = min(least, -ROUNDING * t.n * top)
    if blocked.least_eigenvalue(t, abs(bound), bound) < bound:
        raise ValueError("the Gram matrix is not positive semidefinite; try a lower c")


def grid(rows: DataFrame, block: int) -> tuple[DataFrame, int, int] | None:
    """(rows with own, their block; block size; blocks), None without rows. Blocks are of `block` graphs or fewer: as small as it takes for the pairs of blocks to fill the cores four times."""
    n = rows.agg(F.max("ord")).first()[0]
    if n is None:
        return None
    n = int(n) + 1
    wanted = math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism))  # blocks: half their square are pairs
    size = max(1, min(block, n // wanted or 1))
    return rows.withColumn("own", F.floor(F.col("ord") / size).cast("int")), size, (n - 1) // size + 1


def tasks_of(rows: DataFrame, blocks: int) -> int:
    """Tasks for the pairs of blocks, by number and not by bytes, which tell nothing about the work: a pair each up to 32 for a core."""
    return min(blocks * (blocks + 1) // 2, 32 * rows.sparkSession.sparkContext.defaultParallelism)


def native_blocks(rows: DataFrame, value: Callable[[str, str], Column], block: int = BLOCK, pairs: DataFrame | None = None) -> DataFrame:
    """Gram entries by an expression value(prefix of the first graph's columns, prefix of the second's), one row (ord, columns...) per graph.

    The pair of blocks is the join key: a row goes to as many tasks as there are blocks, not to every other graph. Wanted pairs meet their two rows alone.
    """
    if pairs is not None:
        side = lambda key, at: rows.select(F.col("ord").alias(key), *[F.col(c).alias(at + c) for c in rows.columns if c != "ord"])
        return pairs.select("i", "j").join(side("i", "a_"), "i").join(side("j", "b_"), "j").select("i", "j", value("a_", "b_").alias("k"))
    got = grid(rows, block)
    if got is None:
        return rows.sparkSession.createDataFrame([], "i int, j int, k double")
    own, _, blocks = got
    left = own.withColumn("q", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1)))).withColumnRenamed("own", "p")
    right = own.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumnRenamed("own", "q")
    n = tasks_of(rows, blocks)
    name = lambda df, at: df.select("p", "q", *[F.col(c).alias(at + c) for c in rows.columns]).repartition(n, "p", "q")
    met = name(left, "a_").join(name(right, "b_").hint("shuffle_hash"), ["p", "q"]).where("a_ord <= b_ord")
    return met.select(F.col("a_ord").alias("i"), F.col("b_ord").alias("j"), value("a_", "b_").alias("k"))


def by_blocks(rows: DataFrame, fn, block: int = BLOCK, prep=None, whole: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Gram entries by a Python function of two graphs' rows, over a grid of blocks.

    rows: (ord, columns...), one row per graph. Every row goes to the pairs of blocks it takes part in,
    and a task holds two blocks; fn(a, b) gets dicts of the rows' columns, or what `prep` made of each
    of them, once per block. With `whole`, fn gets the lists of both blocks and returns the matrix of their values. Of wanted
    pairs, only the pairs of blocks that hold some are tasks, with the rows that take part, and only these values are computed.
    """
    got = grid(rows, block)
    if got is None:
        return rows.sparkSession.createDataFrame([], "i int, j int, k double")
    own, size, blocks = got
    if pairs is not None:
        return by_pairs(rows, fn, size, blocks, prep, whole, pairs)
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        recs = pdf.sort_values("ord").to_dict("records")
        made = [(r["ord"], r["own"], prep(r) if prep else r) for r in recs]
        left, right = [m for m in made if m[1] == p], [m for m in made if m[1] == q]
        if whole:
            k = fn([x for _, _, x in left], [x for _, _, x in right])
            out = [(i, j, k[a, b]) for a, (i, _, _) in enumerate(left) for b, (j, _, _) in enumerate(right) if i <= j]
        else:
            out = [(i, j, fn(a, b)) for i, _, a in left for j, _, b in right if i <= j]
        return pd.DataFrame(out, columns=["i", "j", "k"]).astype({"i": "int32", "j": "int32", "k": "float64"})

    return dealt.repartition(tasks_of(rows, blocks), "p", "q").groupBy("p", "q").applyInPandas(run, "i int, j int, k double")


def by_pairs(rows: DataFrame, fn, size: int, blocks: int, prep, whole: bool, pairs: DataFrame) -> DataFrame:
    """by_blocks of wanted pairs: a sparse grid."""
    asked = pairs.select("i", "j", F.floor(F.col("i") / size).cast("int").alias("p"), F.floor(F.col("j") / size).cast("int").alias("q"))
    taking = asked.select("p", "q", F.explode(F.array("i", "j")).alias("ord")).distinct()
    n = tasks_of(rows, blocks)

    def run(given: pd.DataFrame, wish: pd.DataFrame) -> pd.DataFrame:
        made = {r["ord"]: prep(r) if prep else r for r in given.to_dict("records")}
        out = [(i, j, fn([made[i]], [made[j]])[0, 0] if whole else fn(made[i], made[j])) for i, j in zip(wish["i"], wish["j"], strict=True)]
        return pd.DataFrame(out, columns=["i", "j", "k"]).astype({"i": "int32", "j": "int32", "k": "float64"})

    left = taking.join(rows, "ord").repartition(n, "p", "q").groupBy("p", "q")
    wish = asked.select("i", "j", F.col("p").alias("wp"), F.col("q").alias("wq")).repartition(n, "wp", "wq").groupBy("wp", "wq")
    return left.cogroup(wish).applyInPandas(run, "i int, j int, k double")
