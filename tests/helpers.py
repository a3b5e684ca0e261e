"""Small graphs by hand and plain versions of what the engine computes."""

import numpy as np

from graphduo.model import EDGES, GRAPHS, NODES, GraphSet


def graph_set(spark, graphs, directed=False):
    """graphs: list of (sample, labels, attrs or None, edges (src, dst, weight, label))."""
    g, n, e = [], [], []
    for k, (sample, labels, attrs, edges) in enumerate(graphs):
        g.append((k, sample, directed))
        n += [(k, v, lab, None if attrs is None else [float(a) for a in attrs[v]]) for v, lab in enumerate(labels)]
        e += [(k, a, b, float(w), lab) for a, b, w, lab in edges]
    return GraphSet(spark.createDataFrame(g, GRAPHS), spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def plain(edges):
    return [(a, b, 1.0, "S") for a, b in edges]


PATH3 = plain([(0, 1), (1, 2)])
STAR4 = plain([(0, 1), (0, 2), (0, 3)])
K4 = plain([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])
CYCLE5 = plain([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)])


def random_set(spark, n=6, seed=0, nodes=6, p=(0.3, 0.6), weights=False, directed=False):
    rng = np.random.default_rng(seed)
    out = []
    for sample in (1, 2):
        for _ in range(n):
            pairs = [(a, b) for a in range(nodes) for b in range(nodes) if (a != b if directed else a < b)]
            edges = [(a, b, float(rng.normal(1, 0.2)) if weights else 1.0, "ab"[int(rng.random() < 0.5)]) for a, b in pairs if rng.random() < p[sample - 1]]
            out.append((sample, ["xyz"[int(rng.integers(3))] for _ in range(nodes)], rng.normal(size=(nodes, 2)).tolist(), edges))
    return out


def adjacency(g, directed=False, keep=lambda lab: True):
    _, labels, _, edges = g
    a = np.zeros((len(labels), len(labels)))
    for s, t, w, lab in edges:
        if keep(lab):
            a[s, t] = w
            if not directed:
                a[t, s] = w
    return a
