"""Weisfeiler-Lehman refinement and the kernels on its labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphSet
from ..plans.lineage import cut
from . import embedding, gram


def refinement(gs: GraphSet, h: int, missing: str = "-1") -> DataFrame:
    """(graph_id, node_id, it, label) for it = 0 .. h.

    Label t+1 is the hash of the own label and the sorted labels of the (out-)neighbours, so equal
    signatures get equal names in all graphs without a shared dictionary. One neighbour join and
    one aggregation per round; the label columns stay side by side, so no round repeats another.
    Unlabelled nodes have the label `missing`; isolated nodes have a signature of their own label.
    """
    now = gs.nodes.select("graph_id", "node_id", F.coalesce("label", F.lit(missing)).alias("l0"))
    arcs = gs.arcs().select("graph_id", "src", "dst")
    for t in range(1, h + 1):
        last = f"l{t - 1}"
        around = arcs.join(now.select("graph_id", F.col("node_id").alias("dst"), last), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(last)).alias("around"))
        now = now.join(around, ["graph_id", "node_id"], "left").withColumn(f"l{t}", F.md5(F.concat_ws("-", F.col(last), F.array_join(F.coalesce("around", F.array().cast("array<string>")), "-")))).drop("around")
        if t % 3 == 0 and t < h:
            now = cut(now)
    return now.select("graph_id", "node_id", F.posexplode(F.array(*[f"l{t}" for t in range(h + 1)])).alias("it", "label"))


def label_counts(gs: GraphSet, h: int) -> DataFrame:
    """(graph_id, it, label, n)"""
    return refinement(gs, h).groupBy("graph_id", "it", "label").agg(F.count("*").alias("n"))


def frequencies(gs: GraphSet, h: int, per_iteration: bool = False) -> DataFrame:
    """(graph_id, feature, v): relative frequencies over all iterations, or within each."""
    c = label_counts(gs, h)
    keys = ["graph_id", "it"] if per_iteration else ["graph_id"]
    total = c.groupBy(*keys).agg(F.sum("n").alias("all"))
    return c.join(total, keys).select("graph_id", F.concat_ws("+", F.col("it").cast("string"), "label").alias("feature"), (F.col("n") / F.col("all")).alias("v"))


def deep_wl(gs: GraphSet, h: int = 2) -> DataFrame:
    """Inner products of label frequencies over iterations 0 .. h."""
    return gram.dot(frequencies(gs, h), gs.pooled(), pairs=gs.pairs)


def vertex_histogram(gs: GraphSet, h: int = 2) -> DataFrame:
    """Inner products of label counts over iterations 0 .. h."""
    f = label_counts(gs, h).select("graph_id", F.concat_ws("+", F.col("it").cast("string"), "label").alias("feature"), F.col("n").cast("double").alias("v"))
    return gram.dot(f, gs.pooled(), pairs=gs.pairs)


def wasserstein_distance(gs: GraphSet, h: int) -> DataFrame:
    """(i, j, k = distance): labels refine each other, so the ground cost is a tree metric and optimal transport is one minus the mean overlap of histograms."""
    overlap = gram.dot(frequencies(gs, h, per_iteration=True), gs.pooled(), how=lambda a, b: F.sum(F.least(a, b)), pairs=gs.pairs)
    return overlap.select("i", "j", (1.0 - F.col("k") / (h + 1)).alias("k"))


def wasserstein(gs: GraphSet, discount: float, h: int, sinkhorn: bool = False, sinkhorn_lambda: float = 1.0) -> DataFrame:
    """exp(-discount * distance). With sinkhorn, the entropic plan of 50 rounds; its distance of a graph to itself counts twice, as both triangles are added."""
    if not sinkhorn:
        d = wasserstein_distance(gs, h)
    else:
        d = sinkhorn_distance(gs, h, sinkhorn_lambda).select("i", "j", F.when(F.col("i") == F.col("j"), 2 * F.col("k")).otherwise(F.col("k")).alias("k"))
    return d.select("i", "j", F.exp(-discount * F.col("k")).alias("k"))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp along an axis; -inf where all are."""
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def entropic_costs(cost: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, reg: float, rounds: int = 50) -> np.ndarray:
    """Sums of plan * cost after `rounds` Sinkhorn rounds of each problem: cost (m, n, k), masses a (n) and b (m, k), start the first scaling of the rows.

    In logarithms, so that a small reg does not underflow: exp(-1 / reg) is 0 in doubles from reg = 0.0014 on. Masses of 0 are padding.
    """
    with np.errstate(divide="ignore"):
        log_a, log_b, u = np.log(a)[None, :], np.log(b), np.broadcast_to(np.log(start), cost.shape[:2])
    for _ in range(rounds):
        v = log_b - log_sum(u[:, :, None] - cost / reg, 1)
        u = log_a - log_sum(v[:, None, :] - cost / reg, 2)
    return (np.exp(u[:, :, None] + v[:, None, :] - cost / reg) * cost).sum(axis=(1, 2))


def sinkhorn_distance(gs: GraphSet, h: int, reg: float) -> DataFrame:
    """The cost of the entropic plan between label sequences. Nodes of one sequence are one row with their mass, which changes no iterate; a graph meets a block of others as one array."""
    last = "array_join(transform(s, x -> x.label), ',')"
    seq = refinement(gs, h).groupBy("graph_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("it", "label"))).alias("s")).groupBy("graph_id", F.expr(last).alias("name")).agg(F.first("s.label").alias("s"), F.count("*").cast("double").alias("n"))
    rows = gs.pooled().select("graph_id", "ord").join(seq.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("name", "s", "n"))).alias("seqs")), "graph_id").select("ord", "seqs")

    def block(xs, ys):
        number: dict[str, int] = {}

        def coded(row):
            return np.array([[number.setdefault(x, len(number)) for x in s["s"]] for s in row["seqs"]]), np.array([s["n"] for s in row["seqs"]])

        left, right = [coded(x) for x in xs], [coded(y) for y in ys]
        widest = max(len(n) for _, n in right)
        labels, mass = np.full((len(ys), widest, h + 1), -1), np.zeros((len(ys), widest))
        for k, (s, n) in enumerate(right):
            labels[k, : len(n)], mass[k, : len(n)] = s, n / n.sum()
        out = np.zeros((len(xs), len(ys)))
        for k, (s, n) in enumerate(left):
            cost = (s[None, :, None, :] != labels[:, None, :, :]).mean(axis=3)
            out[k] = entropic_costs(cost, n / n.sum(), mass, n, reg)
        return out

    return gram.by_blocks(rows, block, block=gram.SMALL_BLOCK, whole=True, pairs=gs.pairs)


#: The word and the bit of a node as the source of a search: 64 searches run in one long.
WORD, BIT = "cast(floor(node_id / 64) as long)", "shiftleft(1L, cast(pmod(node_id, 64) as int))"


def searches(gs: GraphSet, max_rounds: int = 10_000) -> DataFrame:
    """(graph_id, node_id, word, bits, dist): the sources of a word whose shortest path to the node has dist steps, as bits.

    64 breadth-first searches go side by side: a round moves the bits that nodes won in the last one
    along the arcs, ors them by target and word, and keeps those the target has not seen. What a round shuffles is a row
    per arc and word of sources, not per arc and source. Rounds end when no node wins a bit; a path longer than max_rounds is an error.
    """
    key = ["graph_id", "node_id", "word"]
    arcs = gs.arcs().select("graph_id", F.col("src").alias("node_id"), "dst").distinct()
    front = cut(gs.nodes.select("graph_id", "node_id", F.expr(WORD).alias("word"), F.expr(BIT).alias("bits"), F.lit(0).alias("dist")))
    found, seen = front, front.select(*key, F.col("bits").alias("had"))
    for r in range(1, max_rounds + 1):
        come = front.join(arcs, ["graph_id", "node_id"]).groupBy("graph_id", F.col("dst").alias("node_id"), "word").agg(F.bit_or("bits").alias("come"))
        state = cut(seen.join(come, key, "full").select(*key, F.coalesce("had", F.lit(0)).alias("had"), F.coalesce("come", F.lit(0)).alias("come")))
        front = state.select(*key, F.expr("come & ~had").alias("bits"), F.lit(r).alias("dist")).where("bits != 0")
        if not front.limit(1).count():
            return found
        found, seen = found.unionAll(front), state.select(*key, F.expr("had | come").alias("had"))
    raise RuntimeError(f"paths are longer than {max_rounds}")


def shortest_path_counts(gs: GraphSet, max_rounds: int = 10_000, ordered: bool = False) -> DataFrame:
    """(graph_id, feature, n): how many ordered reachable pairs have (smaller label, larger label, distance), each node with itself at 0.

    The bits of a search are counted against the mask of each label among its 64 sources. `ordered` keeps the labels in the pair's order and leaves distance 0 out.
    """
    masks = gs.nodes.groupBy("graph_id", F.expr(WORD).alias("word"), F.col("label").alias("la")).agg(F.bit_or(F.expr(BIT)).alias("mask"))
    ends = gs.nodes.select("graph_id", "node_id", F.col("label").alias("lb"))
    pair = ("la", "lb") if ordered else (F.least("la", "lb"), F.greatest("la", "lb"))
    met = searches(gs, max_rounds).where("dist > 0" if ordered else "true").join(masks, ["graph_id", "word"]).withColumn("n", F.expr("bit_count(bits & mask)")).where("n > 0")
    return met.join(ends, ["graph_id", "node_id"]).groupBy("graph_id", F.concat_ws("_", *pair, F.col("dist").cast("string")).alias("feature")).agg(F.sum("n").alias("n"))


def shortest_path_features(gs: GraphSet, max_rounds: int = 10_000) -> DataFrame:
    """(graph_id, feature, v): shortest_path_counts as shares of each graph's."""
    c = shortest_path_counts(gs, max_rounds)
    total = c.groupBy("graph_id").agg(F.sum("n").alias("all"))
    return c.join(total, "graph_id").select("graph_id", "feature", (F.col("n") / F.col("all")).alias("v"))


def deep_sp(gs: GraphSet) -> DataFrame:
    return gram.dot(shortest_path_features(gs), gs.pooled(), pairs=gs.pairs)


def deep_word2vec(gs: GraphSet, kind: str = "wl", wl_it: int = 2, vector_size: int = 2, window: int = 2, min_count: int = 0, seed: int = 1) -> DataFrame:
    """P M P' with M = V V' for vectors of the features: each graph's frequency-weighted sum of its features' vectors, dotted; the |features| squared matrix is never formed.

    Vectors are those of embedding.vectors: of the features' positive mutual information within sentences, a graph being the sentence of its features.
    """
    c = cut(counts(gs, kind, wl_it))
    v = embedding.vectors(embedding.cooccurrence(c, window, min_count), vector_size, seed=seed)
    total = c.groupBy("graph_id").agg(F.sum("n").alias("all"))
    long = v.select("feature", F.posexplode("v").alias("dim", "x"))
    place = c.join(total, "graph_id").join(long, "feature").groupBy("graph_id", F.col("dim").cast("string").alias("feature")).agg(F.sum(F.col("n") / F.col("all") * F.col("x")).alias("v"))
    return gram.dot(place, gs.pooled(), pairs=gs.pairs)


def counts(gs: GraphSet, kind: str, wl_it: int = 2) -> DataFrame:
    """(graph_id, feature, n) of label or shortest-path features."""
    if kind == "wl":
        return label_counts(gs, wl_it).select("graph_id", F.concat_ws("+", F.col("it").cast("string"), "label").alias("feature"), "n")
    if kind == "sp":
        return shortest_path_counts(gs)
    raise ValueError(f"type must be 'wl' or 'sp', not {kind!r}")


def optimal_assignment(gs: GraphSet, h: int = 2) -> DataFrame:
    """The overlap of label histograms over iterations 0 .. h: the best assignment of nodes in the hierarchy of their labels."""
    return gram.dot(counts(gs, "wl", h).select("graph_id", "feature", F.col("n").cast("double").alias("v")), gs.pooled(), lambda a, b: F.sum(F.least(a, b)), pairs=gs.pairs)
