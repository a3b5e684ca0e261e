import datetime as dt

import numpy as np
import pytest

from graphduo.operators import estimate
from graphduo.sources import tables
from graphduo.streaming.windows import collected, graph_stream

from .test_estimate_and_sources import correlated

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "sample int, row_idx long, x array<double>, ts timestamp, part int"


def run(spark, tmp_path, rows, **options):
    """The stream over rows (sample, row_idx, x, ts, part), a part after the other, and its last progress."""
    for part in sorted({r[4] for r in rows}):
        spark.createDataFrame([r for r in rows if r[4] == part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"graphs_{tmp_path.name}".replace("-", "_")
    q = graph_stream(stream, 20, [0.02, 0.3], 0.5, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    return spark.table(name), progress


def minute(k):
    return DAY + dt.timedelta(minutes=k)


def shuffled(x, seed, parts=4):
    rng = np.random.default_rng(seed)
    out = [(s, i, [float(v) for v in x[s][i]], minute(i), int(rng.integers(parts))) for s in x for i in range(len(x[s]))]
    return out + [(*out[k][:4], int(rng.integers(parts))) for k in rng.integers(0, len(out), 30)]


def test_shuffled_and_repeated_rows_give_the_batch_graphs(spark, tmp_path):
    """Windows of independent columns have no edges and are there all the same; degrees of labels and attributes follow the batch's."""
    x = {1: correlated(60, 3, seed=5), 2: np.random.default_rng(1).normal(size=(60, 3)) * 0.1}
    options = {"set_attributes": lambda m: m.mean(axis=0), "set_labels": lambda m: {k: str(k % 2) for k in range(m.shape[1])}}
    rows, _ = run(spark, tmp_path, shuffled(x, 3), time="ts", delay="2 hours", **options)
    got = collected(rows)
    want = estimate.estimate_graphs(tables.from_matrix(spark, x[1], x[2]), 20, [0.02, 0.3], 0.5, **options)
    flat = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else [round(a, 9) for a in v] if isinstance(v, list) else v for v in r]) for r in df.collect())
    for name in ("graphs", "nodes", "edges"):
        a, b = getattr(got, name), getattr(want, name)
        assert flat(a.select(*sorted(a.columns))) == flat(b.select(*sorted(a.columns)))
    assert got.graphs.count() == 6 and got.edges.select("graph_id").distinct().count() < 6


def test_state_goes_when_the_stream_has_passed_a_window(spark, tmp_path):
    """A window that never fills, one that was emitted, and a repeated row of it: none is held once the stream is past them, none is emitted twice."""
    x = correlated(60, 3, seed=5)
    row = lambda i, at, part: (1, i, [float(v) for v in x[i]], minute(at), part)
    rows = [row(i, i, 0) for i in range(35)]  # a full window, 15 rows of the next
    rows += [row(3, 3, 1), row(7, 7, 1)]  # repeated after their window was emitted
    rows += [row(40, 500, 2), row(41, 1000, 3)]  # far ahead
    rows += [row(36, 36, 4), row(4, 4, 4)]  # later than the delay
    out, progress = run(spark, tmp_path, rows, time="ts", delay="60 minutes")
    assert [(r["sample"], r["win"]) for r in out.collect()] == [(1, 0)]
    state = progress["stateOperators"][0] if isinstance(progress, dict) else progress.stateOperators[0]
    assert (state["numRowsTotal"] if isinstance(state, dict) else state.numRowsTotal) == 1  # the window of the latest rows


def test_without_a_time_an_emitted_window_leaves_no_state(spark, tmp_path):
    x = {1: correlated(40, 3, seed=2)}
    rows = [(1, i, [float(v) for v in x[1][i]], None, i % 3) for i in range(40)]
    out, progress = run(spark, tmp_path, rows)
    assert sorted(r["win"] for r in out.collect()) == [0, 1]
    assert progress is not None


def test_a_stream_with_an_unknown_time_is_refused(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(Exception, match="when"):
        graph_stream(stream, 20, 0.1, 0.5, time="when")
