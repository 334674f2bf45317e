"""Rules: each is a predicate or an anti-join that names the nodes it holds against, and makes one issue a node.

An issue is a node of its own: issues() gives them as rows, ledger() as nodes and edges of the graph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from .shared import Rounds

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    title: str
    advice: str
    #: Gives (target, message) rows.
    find: Callable[[Graph], DataFrame]


def where(label: str, predicate, message: str = "") -> Callable[[Graph], DataFrame]:
    """Nodes of a label for which a condition holds; a Column, or SQL over the node's columns."""
    return lambda g: g.by_label(label).filter(predicate).select(F.col("id").alias("target"), F.concat(F.lit(message), F.col("name")).alias("message"))


def without(label: str, types: list[str], incoming: bool = True, predicate="true") -> Callable[[Graph], DataFrame]:
    """Nodes of a label without edges of some types on one side."""
    end = "dst" if incoming else "src"
    return lambda g: g.by_label(label).filter(predicate).join(g.of_type(*types).select(F.col(end).alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("target"), F.col("name").alias("message"))


def at_least(label: str, types: list[str], n: int, incoming: bool = True) -> Callable[[Graph], DataFrame]:
    """Nodes of a label that n different nodes or more are tied to by edges of some types.

    Pairs move before they are told apart, each node's in 16 parts, and are sorted, not looked up: few are equal, so a task would keep a table of all its pairs.
    """
    end, other = ("dst", "src") if incoming else ("src", "dst")
    return lambda g: (
        g.of_type(*types).select(F.col(end).alias("id"), F.col(other).alias("other"), F.pmod(F.hash(other), F.lit(16)).alias("part")).filter("other is not null")
        .withColumn("n", F.dense_rank().over(Window.partitionBy("id", "part").orderBy("other"))).groupBy("id", "part").agg(F.max("n").alias("n")).groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= n)
        .join(g.by_label(label), "id").select(F.col("id").alias("target"), F.concat_ws(" ", "name", F.col("n").cast("string")).alias("message"))
    )


def issues(graph: Graph, rules: list[Rule]) -> DataFrame:
    """rule, severity, category, target, message and advice; one row a rule and target."""
    parts = [
        r.find(graph).dropDuplicates(["target"]).select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), "target", "message", F.lit(r.advice).alias("advice"))
        for r in rules
    ]
    return reduce(DataFrame.unionByName, parts)


def filtered(found: DataFrame, least: str = "INFO", category: str | None = None, rule: str | None = None) -> DataFrame:
    """Issues of at least a severity, of a category, of a rule."""
    out = found.filter(F.col("severity").isin(*SEVERITIES[: SEVERITIES.index(least) + 1]))
    if category:
        out = out.filter(F.col("category") == category)
    return out.filter(F.col("rule") == rule) if rule else out


def ledger(found: DataFrame, prefix: str = "") -> Graph:
    """Issue and recommendation nodes, and HAS_ISSUE, AFFECTS and HAS_RECOMMENDATION edges; prefix names the estate."""
    i = Rounds(found.sparkSession).hold(found)  # five tables are made of it
    i = i.withColumn("_rule", F.concat(F.lit(prefix), "rule")).withColumn("id", F.concat(F.lit("issue:"), "_rule", F.lit(":"), "target")).withColumn("advice_id", F.concat(F.lit("advice:"), "_rule"))
    nodes = i.select("id", F.lit("Issue").alias("label"), F.col("message").alias("name"), F.create_map(F.lit("rule"), F.col("_rule"), F.lit("severity"), F.col("severity"), F.lit("category"), F.col("category")).alias("props"), F.lit(0).cast("long").alias("ordinal"))
    advice = i.select(F.col("advice_id").alias("id"), F.lit("Recommendation").alias("label"), F.col("advice").alias("name"), F.create_map(F.lit("rule"), F.col("_rule")).alias("props"), F.lit(0).cast("long").alias("ordinal")).dropDuplicates(["id"])
    edge = lambda a, b, t: i.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("type"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0).cast("long").alias("ordinal"))
    return Graph(nodes.unionByName(advice), edge("target", "id", "HAS_ISSUE").unionByName(edge("id", "target", "AFFECTS")).unionByName(edge("id", "advice_id", "HAS_RECOMMENDATION")))
