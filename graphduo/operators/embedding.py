"""Vectors of features from the sentences they occur in: windowed counts, positive mutual information, a randomised factorisation.

Skip-gram with negative sampling factorises shifted mutual information implicitly (Levy and Goldberg 2014); here the
matrix is a table and its factorisation explicit, so vectors do not depend on the order of training, and all of it runs over all tasks.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Directions followed beyond those asked for, blocks of directions kept before they are cut back to one, most rounds, and the change of an eigenvalue, of the largest, at which rounds end.
SPARE, DEPTH, ROUNDS, SETTLED = 8, 8, 100, 1e-6
#: Eigenvalues below this share of the largest count as zero.
NOTHING = 1e-12


def cooccurrence(counts: DataFrame, window: int, min_count: int = 0) -> DataFrame:
    """(feature, context, n): how often two features stand at most `window` words apart, from counts (graph_id, feature, n > 0), both ways round.

    A sentence is a graph's features in order of name, each n times in a row; it is never written out. A feature is
    a run of positions, only the next `window` runs can come near it, and two runs meet at a distance
    as often as the one overlaps the other shifted. Features with fewer than min_count occurrences in all are left out before.
    """
    c = counts.select("graph_id", "feature", F.col("n").cast("long").alias("n"))
    if min_count > 1:
        c = c.join(c.groupBy("feature").agg(F.sum("n").alias("all")).where(F.col("all") >= min_count).select("feature"), "feature")
    order = Window.partitionBy("graph_id").orderBy("feature")
    end = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = c.select("graph_id", "feature", (end - F.col("n")).alias("lo"), end.alias("hi"))
    near = [F.lead(F.struct("feature", "lo", "hi"), k).over(order) for k in range(1, window + 1)]
    run = run.select("feature", "lo", "hi", F.array(F.struct("feature", "lo", "hi"), *near).alias("cs"))
    met = run.select("feature", "lo", "hi", F.explode("cs").alias("c")).where("c is not null")
    at = [F.greatest(F.lit(0), F.least("hi", F.col("c.hi") - d) - F.greatest("lo", F.col("c.lo") - d)) for d in range(1, window + 1)]
    once = met.select("feature", F.col("c.feature").alias("context"), sum(at[1:], at[0]).alias("n")).where("n > 0").groupBy("feature", "context").agg(F.sum("n").alias("n"))
    both = once.select(F.explode(F.array(F.struct("feature", "context"), F.struct(F.col("context").alias("feature"), F.col("feature").alias("context")))).alias("p"), "n")
    return both.select("p.feature", "p.context", "n").groupBy("feature", "context").agg(F.sum("n").alias("n"))


def mutual_information(met: DataFrame) -> DataFrame:
    """(feature, context, x): log of n N / (n_feature n_context) where it is positive. Symmetric, as the counts are."""
    own = met.groupBy("feature").agg(F.sum("n").alias("f"))
    whole = own.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    x = met.join(own, "feature").join(own.select(F.col("feature").alias("context"), F.col("f").alias("g")), "context")
    return x.select("feature", "context", F.log(F.col("n").cast("double") * float(whole) / F.col("f") / F.col("g")).alias("x")).where("x > 0")


def vectors(met: DataFrame, size: int, spare: int = SPARE, depth: int = DEPTH, rounds: int = ROUNDS, settled: float = SETTLED, seed: int = 1) -> DataFrame:
    """(feature, v array<double>) for every feature of the counts: U sqrt|L| of the `size` eigenpairs of the mutual information that are largest by value; zeros beyond its rank.

    Randomised block Krylov iteration from hashed starts: a round is a join of the table with one row of size + spare numbers per
    feature and a sum by feature; what is new in the result is the next block. Eigenpairs are sought in the span of all blocks.
    The driver sees only products of the blocks' columns with each other, ((depth + 1) (size + spare))^2 numbers at most,
    and gives back the small matrices that combine them; rounds end when the eigenvalues rest, and a warning tells if they do not. Vectors are as near
    as the root of what an eigenvalue may still change; with that at 1e-13 they are the same to 1e-6 at any partitioning.
    Signs are those of a hashed sum. Sums in another order change the last digits only.
    """
    width = size + spare
    block = lambda k: [f"b{k}_{i}" for i in range(width)]
    info, names = cut(mutual_information(met)), cut(met.select("feature").distinct())
    now, held, ours, last = names.select("feature", *[hashed(seed + i).alias(c) for i, c in enumerate(block(0))]), block(0), np.zeros((0, 0)), None
    for _ in range(rounds):
        new = [f"z{i}" for i in range(width)]
        both = cut(product(info, now, held, held[-width:], new))
        g, n = inner(both, held + new), len(held)
        ours = np.pad(ours, (0, n - len(ours)))  # held' A held: the last block's columns are known only now
        ours[:, -width:], ours[-width:] = g[:n, n:], g[:n, n:].T
        base = basis(g[:n, :n])
        lam, u = np.linalg.eigh(base.T @ ours @ base)
        order = np.argsort(-np.abs(lam), kind="stable")
        best = order[:size]
        if last is not None and np.abs(np.abs(lam[best]) - last).max() <= settled * np.abs(lam).max():
            break
        last = np.abs(lam[best])
        if n < depth * width:
            rest = np.vstack([-base @ base.T @ g[:n, n:], np.eye(width)])  # what the product adds to the span
            step = np.hstack([np.eye(n + width)[:, :n], rest @ basis(rest.T @ g @ rest)])
            held = held + block(n // width)
        else:
            step = np.vstack([base @ u[:, order[:width]], np.zeros((width, width))])
            ours, held, last = np.zeros((0, 0)), block(0), None  # the eigenvalues of the next round are these once more
        now = turned(both, both.columns[1:], step, held)
    else:
        warnings.warn(f"eigenvalues still change after {rounds} rounds", stacklevel=2)
    v = turned(both, held, base @ u[:, best] * np.sqrt(np.abs(lam[best])), block(0)[:size])
    sums = v.agg(*[F.sum(F.col(c) * hashed(seed)) for c in block(0)[:size]]).first()
    return v.select("feature", F.array(*[-F.col(c) if (t or 0.0) < 0 else F.col(c) for c, t in zip(block(0)[:size], sums, strict=True)]).alias("v"))


def hashed(seed: int) -> Column:
    """A number in [-1, 1] for a feature, the same everywhere."""
    return F.pmod(F.xxhash64(F.lit(seed), "feature"), F.lit(2_000_003)) / 1_000_001 - 1


def product(info: DataFrame, now: DataFrame, held: list[str], y: list[str], z: list[str]) -> DataFrame:
    """(feature, held, z): the columns held, and as z the matrix times the columns y among them; features without an entry get zeros."""
    sums = info.join(now.select(F.col("feature").alias("context"), *y), "context").groupBy("feature").agg(*[F.sum(F.col("x") * F.col(c)).alias(t) for c, t in zip(y, z, strict=True)])
    return now.join(sums, "feature", "left").select("feature", *held, *[F.coalesce(t, F.lit(0.0)).alias(t) for t in z])


def inner(rows: DataFrame, cols: list[str]) -> np.ndarray:
    """All products of the columns with each other: a matrix per partition, added entry by entry."""

    def part(it):
        g = np.zeros((len(cols), len(cols)))
        for pdf in it:
            x = pdf.to_numpy()
            g += x.T @ x
        yield pd.DataFrame({"at": np.arange(g.size), "v": g.ravel()})

    g = np.zeros(len(cols) ** 2)
    for r in rows.select(*cols).mapInPandas(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        g[r["at"]] = r["v"]
    g = g.reshape(len(cols), len(cols))
    return (g + g.T) / 2


def turned(rows: DataFrame, cols: list[str], by: np.ndarray, to: list[str]) -> DataFrame:
    """The columns times a small matrix, under other names."""

    def part(it):
        for pdf in it:
            out = pd.DataFrame(pdf[cols].to_numpy() @ by, columns=to)
            out.insert(0, "feature", pdf["feature"])
            yield out

    return rows.select("feature", *cols).mapInPandas(part, "feature string, " + ", ".join(f"{c} double" for c in to))


def basis(g: np.ndarray) -> np.ndarray:
    """What turns columns with these products into orthonormal ones, padded by zero columns where they have fewer dimensions."""
    lam, u = np.linalg.eigh(g)
    keep = lam > NOTHING * max(lam.max(), 0.0)
    return np.where(keep, u / np.sqrt(np.where(keep, lam, 1.0)), 0.0)
