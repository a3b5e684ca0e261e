"""Tables that hold samples of graphs, and what every operator derives from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAPHS = "graph_id long, sample int, directed boolean"
NODES = "graph_id long, node_id int, label string, attr array<double>"
EDGES = "graph_id long, src int, dst int, weight double, edge_label string"
OBS = "sample int, row_idx long, x array<double>"
GRAM = "i int, j int, k double"


@dataclass(frozen=True)
class GraphSet:
    """Two samples of graphs: graphs, nodes, edges as in GRAPHS, NODES, EDGES. Undirected edges are stored once."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    #: (i, j), i <= j: the entries of the Gram table that are wanted, where not all are.
    pairs: DataFrame | None = None

    def pooled(self) -> DataFrame:
        """graphs with ord, 0 .. N-1 in order of (sample, graph_id), and pos, the place within the sample. N rows, as many as the Gram matrix has."""
        ord_ = F.row_number().over(Window.orderBy("sample", "graph_id")) - 1
        pos = F.row_number().over(Window.partitionBy("sample").orderBy("graph_id")) - 1
        return self.graphs.select("graph_id", "sample", "directed", ord_.alias("ord"), pos.alias("pos"))

    def arcs(self) -> DataFrame:
        """(graph_id, src, dst, weight, edge_label): undirected edges in both directions, self-loops once, directed ones as they are."""
        e = self.edges.join(self.graphs.select("graph_id", "directed"), "graph_id")
        ends = F.when(F.col("directed") | (F.col("src") == F.col("dst")), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        return e.select("graph_id", F.explode(ends).alias("e"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "edge_label").select("graph_id", "e.src", "e.dst", "weight", "edge_label")

    def degrees(self) -> DataFrame:
        """(graph_id, node_id, degree): edges at a node, a self-loop counting twice, for a directed graph in and out; isolated nodes 0."""
        ends = self.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
        d = ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
        return self.nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def with_degree_labels(self) -> GraphSet:
        d = self.degrees().select("graph_id", "node_id", F.col("degree").cast("string").alias("label"))
        return replace(self, nodes=self.nodes.drop("label").join(d, ["graph_id", "node_id"]).select("graph_id", "node_id", "label", "attr"))

    def with_labels(self, mapping: dict[str, dict[int, str]]) -> GraphSet:
        """Labels given per sample ('1', '2') and node, as a small literal table."""
        spark = self.nodes.sparkSession
        rows = [(int(s), int(n), str(v)) for s, m in mapping.items() for n, v in m.items()]
        table = spark.createDataFrame(rows, "sample int, node_id int, label string")
        at = self.nodes.drop("label").join(self.graphs.select("graph_id", "sample"), "graph_id").join(F.broadcast(table), ["sample", "node_id"], "left")
        return replace(self, nodes=at.select("graph_id", "node_id", "label", "attr"))

    def unweighted(self) -> GraphSet:
        return replace(self, edges=self.edges.withColumn("weight", F.lit(1.0)))

    def sizes(self) -> tuple[int, int]:
        got = {r["sample"]: r["n"] for r in self.graphs.groupBy("sample").agg(F.count("*").alias("n")).collect()}
        return got.get(1, 0), got.get(2, 0)

    def validate(self, label: bool = False, edge_label: bool = False, undirected: bool = False) -> GraphSet:
        """ValueError for an empty input, fewer than two graphs in a sample, missing labels, or directed graphs where only undirected ones make sense."""
        n1, n2 = self.sizes()
        if n1 + n2 == 0:
            raise ValueError("no graphs given")
        if n1 < 2 or n2 < 2:
            raise ValueError(f"each sample needs at least 2 graphs; there are {n1} and {n2}")
        if label and self.nodes.where("label is null").limit(1).count():
            raise ValueError("this kernel needs a label on every node")
        if edge_label and self.edges.where("edge_label is null").limit(1).count():
            raise ValueError("this kernel needs a label on every edge")
        if undirected and self.graphs.where("directed").limit(1).count():
            raise ValueError("this kernel needs undirected graphs (a symmetric adjacency)")
        return self

    def stored(self) -> GraphSet:
        """The three tables computed once and kept in the shared checkpoint folder: kernels read them several times."""
        from .plans.lineage import cut

        return replace(self, graphs=cut(self.graphs), nodes=cut(self.nodes), edges=cut(self.edges))
