"""The property graph: a DataFrame of nodes, one of edges, and what is known about them.

Every node and edge has an ordinal, the place at which a sequential reader would have met it; wherever the
first of several wins, it is the one with the least ordinal. Properties are a map of strings without
empty values: a missing property and an empty one are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "id string, label string, name string, props map<string,string>, ordinal long"
EDGES = "src string, dst string, type string, props map<string,string>, ordinal long"


def present(props: Column) -> Column:
    """The map without null and empty values."""
    return F.map_filter(props, lambda _, v: v.isNotNull() & (v != ""))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)

    def by_label(self, *labels: str) -> DataFrame:
        return self.nodes.filter(F.col("label").isin(*labels))

    def outgoing(self, node_id: str, *types: str) -> DataFrame:
        found = self.edges.filter(F.col("src") == node_id)
        return found.filter(F.col("type").isin(*types)) if types else found

    def incoming(self, node_id: str, *types: str) -> DataFrame:
        found = self.edges.filter(F.col("dst") == node_id)
        return found.filter(F.col("type").isin(*types)) if types else found

    def of_type(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types))

    def degrees(self) -> DataFrame:
        """id, n_in and n_out of every node, 0 where it has none."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
        n = ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum(1 - F.col("e.o")).alias("n_in"))
        return self.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))

    def deduplicated(self, nodes: str = "first", parallel: bool = False, loops: bool = False, dangling: bool = True) -> Graph:
        """One node an id (the first or the last), and edges by policy: parallel ones, self loops and
        edges without both ends are kept or not. Of parallel edges the first stays."""
        order = F.col("ordinal").asc() if nodes == "first" else F.col("ordinal").desc()
        n = self.nodes.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("_k = 1").drop("_k")
        e = self.edges if loops else self.edges.filter("src <> dst")
        if not parallel:
            e = e.withColumn("_k", F.row_number().over(Window.partitionBy("src", "dst", "type").orderBy("ordinal"))).filter("_k = 1").drop("_k")
        if not dangling:
            ids = n.select("id")
            e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(n, e, self.meta)

    def save(self, path: str) -> None:
        """Parquet tables, nodes by label and edges by type, so that filters on them prune files."""
        self.nodes.withColumn("_label", F.col("label")).write.mode("overwrite").partitionBy("_label").parquet(f"{path}/nodes")
        self.edges.withColumn("_type", F.col("type")).write.mode("overwrite").partitionBy("_type").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.parquet(f"{path}/nodes").drop("_label"), spark.read.parquet(f"{path}/edges").drop("_type"))

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Graph:
        """Graph documents: nodes with id, label, name and properties, relationships with start, end, type and
        properties. A later node of the same id replaces an earlier one."""
        schema = (
            "schemaVersion string, meta string, nodes array<struct<id:string,label:string,name:string,properties:map<string,string>>>, "
            "relationships array<struct<start:string,end:string,type:string,properties:map<string,string>>>"
        )
        doc = spark.read.schema(schema).json(path, multiLine=True)
        nodes = doc.select(F.posexplode("nodes").alias("ordinal", "n")).select("n.id", "n.label", "n.name", present(F.col("n.properties")).alias("props"), F.col("ordinal").cast("long"))
        edges = doc.select(F.posexplode("relationships").alias("ordinal", "e")).select(
            F.col("e.start").alias("src"), F.col("e.end").alias("dst"), "e.type", present(F.col("e.properties")).alias("props"), F.col("ordinal").cast("long")
        )
        return cls(nodes, edges).deduplicated("last", parallel=True, loops=True)


def resolve(graph: Graph, reference: str, label: str | None = None) -> DataFrame:
    """All nodes of the first way, in order of preference, by which a reference names any: `Label:` prefix with
    the rest, id, exact name, an identity property without regard to case, path, file stem, end of a path, part of a name."""
    nodes, ref = graph.nodes, reference
    prefix, _, rest = reference.partition(":")
    if label is None and rest and graph.nodes.filter(F.col("label") == prefix).limit(1).count():
        label, ref = prefix, rest
    if label:
        nodes = nodes.filter(F.col("label") == label)
    low = F.lit(ref.lower())
    prop = lambda k: F.col("props")[k]
    keys = ["qualifiedName", "fullName", "alias", "code", "pageId", "externalId"]
    same = F.lit(False)
    for k in keys:
        same = same | F.coalesce(F.lower(prop(k)) == low, F.lit(False))
    stem = F.regexp_extract(F.coalesce(prop("path"), F.lit("")), r"([^/]+?)(?:\.[^./]*)?$", 1)
    tier = (
        F.when(F.col("id").isin(reference, ref), 1).when(F.col("name") == ref, 2).when(same, 3).when(prop("path") == ref, 4)
        .when(F.lower(stem) == low, 5).when(prop("path").endswith("/" + ref), 6).when(F.contains(F.lower("name"), low), 7)
    )
    ranked = nodes.withColumn("tier", tier).filter("tier is not null")
    best = ranked.agg(F.min("tier").alias("best"))
    return ranked.join(best, F.col("tier") == F.col("best")).drop("best").orderBy("ordinal")
