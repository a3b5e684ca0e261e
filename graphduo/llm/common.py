"""What the operators share: columns by name, the shared folder, cut lineage, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): only these two columns are read; a null text is an empty one."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), one of our own, set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='graphduo-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that is removed when the session ends."""
    path = f"{shared_dir(spark)}/graphduo-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read again: later stages neither recompute it nor lose it with an executor."""
    return written(df, what, codec)[0]


def written(df: DataFrame, what: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """cut, and the path of the table, for a caller that removes it once nothing reads it."""
    path, shape = new_path(df.sparkSession, what), df.schema
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(shape).parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted now: Spark does so once the driver has collected its garbage."""
    for _ in range(2):  # what the first round frees lets the second find the rest; the files go in the background
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): (node, comp), comp the least node of the component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is two
    aggregations with map-side partial minima, so a hub costs one row per task, and a chain
    shrinks geometrically. Rounds stop when the edge set no longer changes; running past
    `rounds` is an error, never a silent cut. Rows with a null end are ignored. No edges: no rows.
    """
    spark = edges.sparkSession
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(now, "edges")
    before = None
    for _ in range(rounds):
        # large star: every neighbour above a node hangs itself on the least of the node's neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every lower neighbour, and the node, hang on the least lower neighbour
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last = path
        now, path = written(small.unionAll(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        remove(spark, last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def id_ranges(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most parts - 1 split points of the ids, by one scan of that column alone."""
    spark = docs.sparkSession
    got = docs.agg(F.percentile_approx(docs[id_col].cast("long"), [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("q")).first()["q"]
    return sorted(set(got or []))


def batches_of_rows(it: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a batch at a time."""
    for batch in it:
        yield list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
