"""Graphs from a stream of observations: rows are buffered per window until it is full, then its graph is estimated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import GraphSet
from ..operators.estimate import fit_window

GRAPHS = "sample int, win long, graph_id long, nodes array<struct<node_id int, label string, attr array<double>>>, edges array<struct<src int, dst int, weight double>>"
STATE = "idx array<long>, x array<array<double>>, closed boolean, due long"


def graph_stream(obs: DataFrame, window_size: int, alpha: float | list[float], beta: float, nonparanormal: bool = False, scale: str | bool = False, set_attributes: Callable | None = None, set_labels: Callable | None = None, time: str | None = None, delay: str = "1 hour", **solver) -> DataFrame:
    """A streaming (sample, win, graph_id, nodes, edges) from a streaming OBS: a row, the batch estimate, for each full window, also for one without edges. Options as in estimate_graphs; set_labels is a function.

    State per window of a sample: its rows so far, so windows are dealt over all tasks and rows may arrive in any order
    and twice. A window is emitted when its last row is there.

    time: a timestamp column. When the stream is `delay` past the latest row of a window, the window's state goes: rows of one
    that never filled are dropped, as the batch drops incomplete windows, and of one that was emitted there is only a mark, so that
    rows that come twice start no new window. Rows later than `delay` are dropped. Without it nothing tells
    when a window is over: incomplete ones stay, and a row repeated after its window was emitted opens it again.
    """
    alphas = [float(a) for a in (alpha if hasattr(alpha, "__len__") else [alpha])]

    def graph(x: np.ndarray) -> tuple[list, list]:
        theta, _, _ = fit_window(x, alphas, beta, nonparanormal, scale, **solver)
        attr, lab = set_attributes(x) if set_attributes else None, set_labels(x) if set_labels else {}
        nodes = [{"node_id": k, "label": None if lab.get(k) is None else str(lab[k]), "attr": None if attr is None else [float(v) for v in np.atleast_1d(attr[k])]} for k in range(x.shape[1])]
        return nodes, [{"src": int(i), "dst": int(j), "weight": float(theta[i, j])} for i, j in np.argwhere(np.triu(theta, 1) != 0)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        idx, held, closed, due = state.get if state.exists else ([], [], False, 0)
        rows = {int(i): list(v) for i, v in zip(idx, held, strict=True)}
        for pdf in batches:
            rows.update({int(i): [float(v) for v in x] for i, x in zip(pdf["row_idx"], pdf["x"], strict=True)})
            due = max(due, int(pdf["due"].max()))
        full = not closed and len(rows) == window_size
        if full:
            nodes, edges = graph(np.array([rows[i] for i in sorted(rows)]))
            yield pd.DataFrame([{"sample": int(key[0]), "win": int(key[1]), "graph_id": int(key[1]) * 2 + int(key[0]) - 1, "nodes": nodes, "edges": edges}])
        closed = closed or full
        if closed and not time:
            if state.exists:
                state.remove()
            return
        state.update(([], [], True, due) if closed else (list(rows), list(rows.values()), False, due))
        if time:
            state.setTimeoutTimestamp(due)

    placed = obs.withColumn("win", F.floor(F.col("row_idx") / window_size).cast("long")).withColumn("due", F.unix_millis(F.col(time)) if time else F.lit(0).cast("long"))
    placed = placed.withWatermark(time, delay) if time else placed
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return placed.groupBy("sample", "win").applyInPandasWithState(run, GRAPHS, STATE, "append", timeout)


def estimate_stream(obs: DataFrame, window_size: int, alpha: float | list[float], beta: float, **options) -> DataFrame:
    """The edges of graph_stream: (sample, win, src, dst, weight)."""
    g = graph_stream(obs, window_size, alpha, beta, **options)
    return g.select("sample", "win", F.explode("edges").alias("e")).select("sample", "win", "e.src", "e.dst", "e.weight")


def collected(graphs: DataFrame) -> GraphSet:
    """The graphs that a stream has written so far, as tables for the kernels and tests."""
    nodes = graphs.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.node_id", "n.label", "n.attr")
    edges = graphs.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.src", "e.dst", "e.weight", F.lit(None).cast("string").alias("edge_label"))
    return GraphSet(graphs.select("graph_id", "sample", F.lit(False).alias("directed")), nodes, edges)
