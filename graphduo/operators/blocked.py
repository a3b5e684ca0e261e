"""A Gram table as square tiles: products with it, its least eigenvalue, a factor, and the sums of resamples. No step holds the matrix whole."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Rows of a tile, at most: 512 KB of doubles.
TILE = 256
#: Bytes of vectors (graphs x columns) that the driver holds and sends to the workers.
VECTORS = 256 << 20


class Tiles:
    """rows (p, q, tile binary), p <= q: block row p against block row q, `edge` graphs in a block, of an n x n matrix; diagonal tiles are whole."""

    def __init__(self, rows: DataFrame, n: int, edge: int):
        self.rows, self.n, self.edge = rows, n, edge
        self.blocks = (n + edge - 1) // edge if n else 0

    def tasks(self) -> int:
        return max(1, min(self.blocks * (self.blocks + 1) // 2, 32 * self.rows.sparkSession.sparkContext.defaultParallelism))

    def span(self, p: int) -> tuple[int, int]:
        return p * self.edge, min(self.n, (p + 1) * self.edge)


def tiles(gram: DataFrame, n: int, edge: int | None = None) -> Tiles:
    """A Gram table (i <= j) in tiles, stored; edge: so that the tiles fill the cores four times, at most TILE. Missing entries are 0."""
    shape = shaped(gram, n, edge)
    edge = shape.edge

    def run(key, pdf):
        (a, b), (c, d) = shape_span(n, edge, key[0]), shape_span(n, edge, key[1])
        tile = np.zeros((b - a, d - c))
        tile[pdf["i"] - a, pdf["j"] - c] = pdf["k"]
        if key[0] == key[1]:
            tile = np.triu(tile) + np.triu(tile, 1).T
        return pd.DataFrame([(key[0], key[1], tile.tobytes())], columns=["p", "q", "tile"])

    placed = gram.select("i", "j", "k", F.floor(F.col("i") / edge).cast("int").alias("p"), F.floor(F.col("j") / edge).cast("int").alias("q"))
    return Tiles(cut(placed.repartition(shape.tasks(), "p", "q").groupBy("p", "q").applyInPandas(run, "p int, q int, tile binary")), n, edge)


def shaped(rows: DataFrame, n: int, edge: int | None = None) -> Tiles:
    wanted = math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism))
    return Tiles(rows, n, edge or max(1, min(TILE, math.ceil(n / wanted))))


def computed(rows: DataFrame, n: int, pack: Callable[[pd.DataFrame], np.ndarray], value: Callable[[np.ndarray, np.ndarray], np.ndarray], edge: int | None = None) -> Tiles:
    """Tiles from what their entries are made of, stored; no entry is ever a row, of which there would be n^2 / 2.

    rows: (ord, columns...), one for each graph, ord 0 .. n-1. pack: a block's rows, in order of ord, to an array with a row per graph.
    value: the arrays of two blocks to the matrix of their entries.
    """
    shape = shaped(rows, n, edge)
    edge, blocks = shape.edge, shape.blocks

    def packed(key, pdf):
        return pd.DataFrame([(key[0], np.ascontiguousarray(pack(pdf.sort_values("ord")), float).tobytes())], columns=["block", "data"])

    def run(it):
        for pdf in it:
            out = []
            for p, q, left, right in zip(pdf["p"], pdf["q"], pdf["a"], pdf["b"], strict=True):
                (a, b), (c, d) = shape_span(n, edge, p), shape_span(n, edge, q)
                tile = value(np.frombuffer(left).reshape(b - a, -1), np.frombuffer(right).reshape(d - c, -1))
                out.append((p, q, (np.triu(tile) + np.triu(tile, 1).T if p == q else tile).tobytes()))
            yield pd.DataFrame(out, columns=["p", "q", "tile"])

    block = cut(rows.withColumn("block", F.floor(F.col("ord") / edge).cast("int")).groupBy("block").applyInPandas(packed, "block int, data binary"))
    left = block.select(F.col("block").alias("p"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("q"), F.col("data").alias("a"))
    right = block.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("p"), F.col("block").alias("q"), F.col("data").alias("b"))
    met = left.repartition(shape.tasks(), "p", "q").join(right.repartition(shape.tasks(), "p", "q").hint("shuffle_hash"), ["p", "q"])
    return Tiles(cut(met.select("p", "q", "a", "b").mapInPandas(run, "p int, q int, tile binary")), n, edge)


def largest(t: Tiles) -> float:
    """The largest absolute entry."""

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"top": [max((float(np.abs(np.frombuffer(x)).max(initial=0.0)) for x in pdf["tile"]), default=0.0)]})

    return float(t.rows.select("tile").mapInPandas(run, "top double").agg(F.max("top")).first()[0] or 0.0)


def shape_span(n: int, edge: int, p: int) -> tuple[int, int]:
    return int(p) * edge, min(n, (int(p) + 1) * edge)


def times(t: Tiles, v: np.ndarray) -> np.ndarray:
    """K v for n x m vectors: they go to the workers, every task adds up what its tiles give, and block rows of sums come back."""
    if v.nbytes > VECTORS:
        raise ValueError(f"{v.shape[1]} vectors of {v.shape[0]} graphs are over {VECTORS} bytes")
    sent = t.rows.sparkSession.sparkContext.broadcast(v)
    n, edge, m = t.n, t.edge, v.shape[1]

    def run(it):
        sums: dict[int, np.ndarray] = {}

        def add(p, x):
            sums[p] = sums[p] + x if p in sums else x

        for pdf in it:
            for p, q, raw in zip(pdf["p"], pdf["q"], pdf["tile"], strict=True):
                (a, b), (c, d) = shape_span(n, edge, p), shape_span(n, edge, q)
                tile = np.frombuffer(raw).reshape(b - a, d - c)
                add(p, tile @ sent.value[c:d])
                if p != q:
                    add(q, tile.T @ sent.value[a:b])
        yield pd.DataFrame([(int(p), x.tobytes()) for p, x in sums.items()], columns=["p", "x"])

    def total(key, pdf):
        return pd.DataFrame([(key[0], sum(np.frombuffer(x) for x in pdf["x"]).tobytes())], columns=["p", "x"])

    out = np.zeros((n, m))
    for r in t.rows.mapInPandas(run, "p int, x binary").groupBy("p").applyInPandas(total, "p int, x binary").collect():  # n x m numbers
        a, b = t.span(r["p"])
        out[a:b] = np.frombuffer(r["x"]).reshape(b - a, m)
    sent.destroy()
    return out


def krylov(t: Tiles, width: int, tol: float, most: int, enough=None) -> tuple[np.ndarray, np.ndarray, float]:
    """(Q, Q'KQ, what is left): an orthonormal basis by block Lanczos with full orthogonalisation, until K Q lies in Q to within tol
    (largest column norm), the space is whole, it has `most` columns, or enough(Q, KQ) holds. One pass over the tiles per block of `width` vectors."""
    n = t.n
    new = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(width, n))))[0]
    q, kq, rest = np.zeros((n, 0)), np.zeros((n, 0)), 0.0
    while True:
        q, kq = np.hstack([q, new]), np.hstack([kq, times(t, new)])
        left = kq[:, -new.shape[1] :]
        for _ in range(2):
            left = left - q @ (q.T @ left)
        rest = float(np.linalg.norm(left, axis=0).max(initial=0.0)) if q.shape[1] < n else 0.0
        if rest <= tol or q.shape[1] >= most or (enough is not None and enough(q, kq)):
            return q, (q.T @ kq + kq.T @ q) / 2, rest
        u, s, _ = np.linalg.svd(left, full_matrices=False)
        new = u[:, : min(int((s > tol / 10).sum()) or 1, n - q.shape[1], most - q.shape[1])]
        new = np.linalg.qr(new - q @ (q.T @ new))[0]


def least_eigenvalue(t: Tiles, tol: float = 1e-11, below: float | None = None, width: int = 64) -> float:
    """The least eigenvalue to within tol, or any value under `below` that some vector's Rayleigh quotient shows to be no more than one."""
    if not t.n:
        return 0.0
    found = [0.0]

    def enough(q, kq):
        theta, s = np.linalg.eigh((q.T @ kq + kq.T @ q) / 2)
        found[0] = float(theta[0])
        return (below is not None and theta[0] < below) or float(np.linalg.norm(kq @ s[:, 0] - theta[0] * (q @ s[:, 0]))) <= tol

    most = min(t.n, VECTORS // (16 * t.n))
    q, m, rest = krylov(t, width, 0.0, most, enough)
    if q.shape[1] == most < t.n and rest > tol and not (below is not None and found[0] < below):
        raise ValueError(f"the least eigenvalue has not settled in {most} vectors")
    return float(np.linalg.eigvalsh(m)[0])


class Factor:
    """K = basis core basis' and its positive part = plus plus', n x m each, m the rank of K within the tolerance."""

    def __init__(self, basis: np.ndarray, core: np.ndarray, plus: np.ndarray):
        self.basis, self.core, self.plus = basis, core, plus


def factor(t: Tiles, tol: float = 1e-10, width: int = 64) -> Factor:
    """Factor of a symmetric matrix that may be indefinite: eigenvalues of the core that are not positive are clipped in `plus`. tol: as a share of the largest entry of the core."""
    scale = float(np.abs(times(t, np.ones((t.n, 1)) / math.sqrt(t.n))).max(initial=0.0)) or 1.0
    most = min(t.n, VECTORS // (24 * t.n))
    q, core, rest = krylov(t, width, tol * scale, most)
    if rest > tol * scale:
        raise ValueError(f"the matrix has a rank over {most}, or over what {VECTORS} bytes hold")
    lam, u = np.linalg.eigh(core)
    return Factor(q, core, q @ (u * np.sqrt(np.maximum(lam, 0))))


def resample_sums(t: Tiles, draws: DataFrame, b: int) -> DataFrame:
    """(b, xx, yy, dx, dy, xy) for draws (b in 1 .. B, ord, a): sums of K over pairs within and between the samples; a graph may be drawn more than once.

    A block of graphs' counts, a column per resample, meets every tile of its block row or column: one shuffle of
    tiles and counts, two products for a tile and all resamples, sums added up before they are shuffled.
    """
    n, edge, blocks = t.n, t.edge, t.blocks

    def count(key, pdf):
        a, e = shape_span(n, edge, key[0])
        out = []
        for sample in (1, 2):
            own = pdf[pdf["a"] == sample]
            c = np.zeros((e - a, b), np.uint16)
            np.add.at(c, (own["ord"].to_numpy() - a, own["b"].to_numpy() - 1), 1)
            out.append(c.tobytes())
        return pd.DataFrame([(key[0], *out)], columns=["block", "first", "second"])

    counted = cut(draws.select("b", "ord", "a", F.floor(F.col("ord") / edge).cast("int").alias("block")).groupBy("block").applyInPandas(count, "block int, first binary, second binary"))
    nothing = F.lit(None).cast("binary")
    left = counted.select(F.col("block").alias("p"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("q"), F.lit(1).alias("kind"), "first", "second")
    right = counted.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("p"), F.col("block").alias("q"), F.lit(2).alias("kind"), "first", "second")
    met = t.rows.select("p", "q", F.lit(0).alias("kind"), F.col("tile").alias("first"), nothing.alias("second")).unionByName(left).unionByName(right)

    def run(key, pdf):
        (a, e), (c, d) = shape_span(n, edge, key[0]), shape_span(n, edge, key[1])
        rows = {k: (f, s) for k, f, s in zip(pdf["kind"], pdf["first"], pdf["second"], strict=True)}
        names = ["b", "xx", "yy", "dx", "dy", "xy"]
        if len(rows) < 3:  # a tile of zeros, or a block that no resample drew
            return pd.DataFrame({c: np.zeros(0) for c in names}).astype({"b": "int32"})
        tile = np.frombuffer(rows[0][0]).reshape(e - a, d - c)
        p1, p2 = (np.frombuffer(x, np.uint16).reshape(e - a, b).astype(float) for x in rows[1])
        q1, q2 = (np.frombuffer(x, np.uint16).reshape(d - c, b).astype(float) for x in rows[2])
        k1, k2 = tile @ q1, tile @ q2
        if key[0] == key[1]:
            diag = tile.diagonal()
            sums = ((p1 * k1).sum(0), (p2 * k2).sum(0), diag @ p1, diag @ p2, (p2 * k1).sum(0))
        else:
            zero = np.zeros(b)
            sums = (2 * (p1 * k1).sum(0), 2 * (p2 * k2).sum(0), zero, zero, (p2 * k1).sum(0) + (p1 * k2).sum(0))
        return pd.DataFrame(dict(zip(names, (np.arange(1, b + 1, dtype=np.int32), *sums), strict=True)))

    each = met.repartition(t.tasks(), "p", "q").groupBy("p", "q").applyInPandas(run, "b int, xx double, yy double, dx double, dy double, xy double")
    return each.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "dx", "dy", "xy")])
