"""The driver's relational tables as a dependency graph: each edge goes from what depends to what it depends on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph

WEIGHTS = {"PART_OF": 0.9, "LOCATED_IN": 0.8, "PLACED_BY": 1.0, "SUPPLIED_BY": 0.7, "CONTAINS": 0.4}
_LABELS = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("order", "o_orderkey", "o_orderpriority")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_graph(spark: SparkSession, sf_dir: str, parallel: bool = False) -> Graph:
    """With parallel, an edge comes as often as lines of orders have it, which saves three shuffles of them, for what counts no edges."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda label, c: F.concat(F.lit(label + ":"), F.col(c).cast("string"))
    none = F.create_map().cast("map<string,string>")
    nodes = [
        t("orders" if label == "order" else label).select(key(label, k).alias("id"), F.lit(label).alias("label"), F.col(n).alias("name"), none.alias("props"), (F.lit(i << 40) + F.col(k)).cast("long").alias("ordinal"))
        for i, (label, k, n) in enumerate(_LABELS)
    ]
    lines = t("lineitem")
    once = (lambda df: df) if parallel else DataFrame.distinct
    e = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    edges = [
        e(t("nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "PART_OF"),
        e(t("customer"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "LOCATED_IN"),
        e(t("supplier"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "LOCATED_IN"),
        e(t("orders"), key("order", "o_orderkey"), key("customer", "o_custkey"), "PLACED_BY"),
        e(once(lines.select("l_orderkey", "l_suppkey")), key("order", "l_orderkey"), key("supplier", "l_suppkey"), "SUPPLIED_BY"),
        e(once(lines.select("l_partkey", "l_suppkey")), key("part", "l_partkey"), key("supplier", "l_suppkey"), "SUPPLIED_BY"),
        e(once(lines.select("l_orderkey", "l_partkey")), key("order", "l_orderkey"), key("part", "l_partkey"), "CONTAINS"),
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Graph(union(nodes), union(edges).withColumn("props", none).withColumn("ordinal", F.lit(0).cast("long")))
