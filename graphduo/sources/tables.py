"""Graphs and matrices from tables, files and Python objects; and back to files."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGES, GRAPHS, NODES, OBS, GraphSet
from ..plans.lineage import cut

FORMATS = ("parquet", "orc", "json", "csv")
#: Items of orders in a task, where a core has more than that: joins, sets and pairs of a stage take some 2 KB of its memory for each.
ITEMS = 250_000


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> GraphSet:
    """A GraphSet from <path>/graphs, nodes, edges in a columnar or text format; csv keeps node attributes as space-separated numbers."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    load = lambda name, ddl: spark.read.format(fmt).schema(ddl).options(**({"header": "true"} if fmt == "csv" else {})).load(f"{path}/{name}")
    if fmt == "csv":
        nodes = load("nodes", NODES.replace("array<double>", "string")).withColumn("attr", F.split("attr", " ").cast("array<double>"))
    else:
        nodes = load("nodes", NODES)
    return GraphSet(load("graphs", GRAPHS), nodes, load("edges", EDGES))


def write(gs: GraphSet, path: str, fmt: str = "parquet") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    for name, df in (("graphs", gs.graphs), ("nodes", gs.nodes), ("edges", gs.edges)):
        if fmt == "csv" and name == "nodes":
            df = df.withColumn("attr", F.concat_ws(" ", F.col("attr").cast("array<string>")))
        df.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).mode("overwrite").save(f"{path}/{name}")


def from_objects(spark: SparkSession, g1: Iterable, g2: Iterable, node_label: str | None = None, node_attr: str | None = None, edge_attr: str | None = None, edge_label: str | None = None) -> GraphSet:
    """Two lists of graph objects with nodes(data=True), edges(data=True) and is_directed(), as graph libraries for Python have them; nodes are renumbered 0 .. n-1 in their order."""
    graphs, nodes, edges = [], [], []
    for k, (sample, g) in enumerate([(1, g) for g in g1] + [(2, g) for g in g2]):
        graphs.append((k, sample, bool(g.is_directed())))
        at = {}
        for v, data in g.nodes(data=True):
            at[v] = len(at)
            attr = data.get(node_attr) if node_attr else None
            attr = None if attr is None else [float(x) for x in (attr if hasattr(attr, "__len__") else [attr])]
            nodes.append((k, at[v], None if node_label is None or data.get(node_label) is None else str(data[node_label]), attr))
        for u, v, data in g.edges(data=True):
            a, b = (at[u], at[v]) if g.is_directed() or at[u] <= at[v] else (at[v], at[u])
            edges.append((k, a, b, float(data[edge_attr]) if edge_attr else 1.0, None if edge_label is None else str(data[edge_label])))
    return GraphSet(spark.createDataFrame(graphs, GRAPHS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def from_matrix(spark: SparkSession, x1, x2) -> DataFrame:
    """Two matrices (rows are observations in order) as OBS."""
    rows = [(s, i, [float(v) for v in r]) for s, x in ((1, x1), (2, x2)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, OBS)


def gram_from_matrix(spark: SparkSession, k) -> DataFrame:
    """A precomputed square matrix as GRAM (upper triangle)."""
    n = len(k)
    if any(len(r) != n for r in k):
        raise ValueError("a Gram matrix is square")
    return spark.createDataFrame([(i, j, float(k[i][j])) for i in range(n) for j in range(i, n)], "i int, j int, k double")


def co_purchase(spark: SparkSession, sf_dir: str) -> GraphSet:
    """Undirected graphs of brands bought in one order: one graph for each nation and order priority, sample by the nation's parity.

    An edge is a pair of brands that more orders hold than the average pair of that graph;
    weight = orders, edge label = S if a pair of its items was returned alike, else D; node attribute = mean discount.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines, n = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_discount"), item_tasks(t("lineitem"))
    # the tables grow together: where they are large, tasks by the number of items, and no side is sent whole to every task
    dealt = lambda df, key: df.repartition(n, key).hint("merge") if n else df
    orders = dealt(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey").join(dealt(t("customer").select("c_custkey", "c_nationkey"), "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    graph = F.col("c_nationkey").cast("long") * 10 + F.substring("o_orderpriority", 1, 1).cast("int")
    items = dealt(lines, "l_partkey").join(dealt(t("part").select("p_partkey", "p_brand"), "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    items = dealt(items.drop("l_partkey", "p_partkey"), "l_orderkey").join(dealt(orders.drop("o_custkey", "c_custkey"), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.select(graph.alias("graph_id"), "l_orderkey", "p_brand", "l_returnflag", "l_discount")
    rank = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("p_brand")) - 1
    brands = items.groupBy("graph_id", "p_brand").agg(F.avg("l_discount").alias("d")).select("graph_id", rank.alias("node_id"), F.col("p_brand").alias("label"), F.array("d").alias("attr"))
    brands = cut(brands)  # a row per graph and brand, which graphs, nodes and edges all start from
    # one row per order: its items; pairs are formed inside the row. Sorted, a brand's first entry stands for it, so each pair of an order counts once and no row is kept for it
    baskets = items.groupBy("graph_id", "l_orderkey").agg(F.sort_array(F.collect_set(F.struct("p_brand", "l_returnflag"))).alias("b"))
    first = lambda k: (F.col(k) == 0) | ~F.get("b", F.col(k) - 1)["p_brand"].eqNullSafe(F.get("b", F.col(k))["p_brand"])
    one = baskets.select("graph_id", "b", F.posexplode("b").alias("i", "x")).select("graph_id", "b", "i", "x", F.posexplode("b").alias("j", "y")).where("x.p_brand < y.p_brand")
    one = one.select("graph_id", F.col("x.p_brand").alias("a"), F.col("y.p_brand").alias("b"), (first("i") & first("j")).cast("long").alias("n"), (F.col("x.l_returnflag") == F.col("y.l_returnflag")).alias("same"))
    pairs = one.groupBy("graph_id", "a", "b").agg(F.sum("n").cast("double").alias("weight"), F.when(F.max("same"), "S").otherwise("D").alias("edge_label"))
    pairs = pairs.withColumn("mean", F.avg("weight").over(Window.partitionBy("graph_id"))).where("weight > mean")
    at = brands.select("graph_id", "label", "node_id")
    edges = pairs.join(at.select("graph_id", F.col("label").alias("a"), F.col("node_id").alias("src")), ["graph_id", "a"]).join(at.select("graph_id", F.col("label").alias("b"), F.col("node_id").alias("dst")), ["graph_id", "b"])
    graphs = brands.select("graph_id").distinct().select("graph_id", (1 + F.floor(F.col("graph_id") / 10) % 2).cast("int").alias("sample"), F.lit(False).alias("directed"))
    return GraphSet(graphs, brands, edges.select("graph_id", "src", "dst", "weight", "edge_label"))


def item_tasks(lines: DataFrame) -> int:
    """Tasks for the items of orders, by their number: by bytes, several million would come together, as shuffles pack them well. 0 where there is no more than a task for each core."""
    n, spark = math.ceil(lines.count() / ITEMS), lines.sparkSession
    # fewer than the session's own number would be dealt anew, to that number, before each join
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else 0


def event_transitions(spark: SparkSession, sf_dir: str) -> GraphSet:
    """Directed graphs of event types, one for each day: edges lead to the same user's next event of that day, weight = how often. Sample 2 from the 16th on."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    nxt = F.lead("event_type").over(Window.partitionBy("day", "user_id").orderBy("ts", "event_id"))
    ev = ev.select(F.date_format("day", "yyyyMMdd").cast("long").alias("graph_id"), "event_type", nxt.alias("next"))
    types = ev.select("graph_id", "event_type").distinct()
    nodes = types.select("graph_id", (F.dense_rank().over(Window.partitionBy("graph_id").orderBy("event_type")) - 1).alias("node_id"), F.col("event_type").alias("label"), F.lit(None).cast("array<double>").alias("attr"))
    e = ev.where("next is not null").groupBy("graph_id", "event_type", "next").agg(F.count("*").cast("double").alias("weight"))
    at = nodes.select("graph_id", "label", "node_id")
    e = e.join(at.select("graph_id", F.col("label").alias("event_type"), F.col("node_id").alias("src")), ["graph_id", "event_type"]).join(at.select("graph_id", F.col("label").alias("next"), F.col("node_id").alias("dst")), ["graph_id", "next"])
    graphs = types.select("graph_id").distinct().select("graph_id", F.when(F.col("graph_id") % 100 < 16, 1).otherwise(2).alias("sample"), F.lit(True).alias("directed"))
    return GraphSet(graphs, nodes, e.select("graph_id", "src", "dst", "weight", F.lit(None).cast("string").alias("edge_label")))


def embedding_matrix(spark: SparkSession, sf_dir: str, dims: int | None = None, window: int = 25) -> DataFrame:
    """OBS from the embeddings, all their columns or the first dims: successive windows of vec_id go to the samples in turn."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select((1 + F.floor(F.col("vec_id") / window) % 2).cast("int").alias("sample"), F.col("vec_id").alias("row_idx"), (F.col("embedding") if dims is None else F.slice("embedding", 1, dims)).cast("array<double>").alias("x"))
