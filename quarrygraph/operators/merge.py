"""Several estates as one graph: union, merge with arbitration, difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, present

#: Keys that merging leaves alone.
RESERVED = ("estate", "estates", "origin", "label")
AUTHORITY = {"dictionary": 1}


def federate(estates: list[tuple[str, Graph]], shared: str = "db:") -> tuple[DataFrame, DataFrame]:
    """Contributions of nodes (id, label, name, props, ordinal, estate, rank) and edges of all estates in order. Ids are put
    under their estate's name, but those that begin with the shared prefix are the same everywhere."""
    spaced = lambda c, e: F.when(F.col(c).startswith(shared), F.col(c)).otherwise(F.concat(F.lit(e + "/"), F.col(c)))
    nodes, edges = [], []
    for rank, (name, g) in enumerate(estates):
        nodes.append(g.nodes.withColumn("id", spaced("id", name)).withColumn("estate", F.lit(name)).withColumn("rank", F.lit(rank)))
        edges.append(g.edges.withColumn("src", spaced("src", name)).withColumn("dst", spaced("dst", name)).withColumn("estate", F.lit(name)).withColumn("rank", F.lit(rank)))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union(nodes), union(edges)


def merge_nodes(contributions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one id as one, and the conflicts.

    The first contributor is the base. An empty value is filled; an equal one is ignored; one from a higher
    authority (a dictionary) overrides; each value that loses is a conflict (id, key, kept, lost, kept_from,
    lost_from, resolved_by), as is a label other than the first. Values of a key are folded in order,
    so no more than one row a contributor is ever held. estate is the first contributor's, estates are all.
    """
    c = contributions.withColumn("_at", F.struct("rank", "ordinal")).withColumn("_sure", F.when(F.col("props")["origin"] == "dictionary", 1).otherwise(0))
    base = c.groupBy("id").agg(F.min_by("label", "_at").alias("label"), F.min_by("name", "_at").alias("name"), F.min(F.struct("rank", "ordinal")).alias("_first"), F.min_by("estate", "_at").alias("estate"), F.array_sort(F.collect_set("estate")).alias("estates"))
    keys = c.select("id", "rank", "ordinal", "estate", "_sure", F.explode(present(F.col("props"))).alias("key", "value")).filter(~F.col("key").isin(*RESERVED))
    w = Window.partitionBy("id", "key")
    ordered = w.orderBy(F.desc("_sure"), "rank", "ordinal")
    ranked = keys.withColumn("kept", F.first("value").over(ordered)).withColumn("kept_from", F.first("estate").over(ordered)).withColumn("_top", F.first("_sure").over(ordered))
    props = ranked.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "kept")))).alias("props"))
    lost = ranked.filter(F.col("value") != F.col("kept")).select(
        "id", "key", "kept", F.col("value").alias("lost"), "kept_from", F.col("estate").alias("lost_from"), F.when(F.col("_top") > F.col("_sure"), "authority").otherwise("first").alias("resolved_by")
    )
    labels = c.join(base.select("id", F.col("label").alias("_label")), "id").filter(F.col("label") != F.col("_label")).select(
        "id", F.lit("label").alias("key"), F.col("_label").alias("kept"), F.col("label").alias("lost"), F.lit(None).cast("string").alias("kept_from"), F.col("estate").alias("lost_from"), F.lit("first").alias("resolved_by")
    )
    merged = base.join(props, "id", "left").select("id", "label", "name", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "estate", "estates", F.col("_first.ordinal").alias("ordinal"))
    return merged, lost.unionByName(labels).distinct()


def merge_edges(contributions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first of equal edges, if both ends are there."""
    first = contributions.withColumn("_k", F.row_number().over(Window.partitionBy("src", "dst", "type").orderBy("rank", "ordinal"))).filter("_k = 1").drop("_k")
    ids = nodes.select("id")
    return first.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def federated(estates: list[tuple[str, Graph]], shared: str = "db:") -> tuple[Graph, DataFrame]:
    """All estates as one graph, and the conflicts. The properties estate and estates of a node name its first contributor
    and, between semicolons, all of them."""
    nodes, edges = federate(estates, shared)
    merged, conflicts = merge_nodes(nodes)
    kept = merge_edges(edges, merged)
    origin = F.create_map(F.lit("estate"), F.col("estate"), F.lit("estates"), F.array_join("estates", ";"))
    return Graph(merged.withColumn("props", F.map_concat("props", origin)).drop("estate", "estates"), kept.select("src", "dst", "type", "props", "ordinal")), conflicts


def diff(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key and change (added, removed, changed) of two tables with a unique key; equal rows are left out. Nulls are equal."""
    a, b = before.select(key, F.struct(*compared).alias("_a")), after.select(key, F.struct(*compared).alias("_b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")
