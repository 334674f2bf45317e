"""Checks of a graph; each is a table of findings (severity, rule, detail), and their union is the report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from .shared import Rounds

Check = Callable[[Graph], DataFrame]
_RANK = {"ERROR": 0, "WARNING": 1, "INFO": 2}


def finding(rows: DataFrame, severity: str, rule: str, detail) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _odd(graph: Graph) -> DataFrame:
    """id, n (nodes) and tied (to an edge) of ids that not just one node has, and of those without an edge. One count over nodes and ends, made once
    for all checks of a graph; in a sound graph few are left, so that what is looked up by them moves no table."""
    held = graph.__dict__.get("_odd")
    if held is None or not held[0].there():
        rounds = Rounds(graph.nodes.sparkSession)
        ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).select("id", F.lit(0).alias("n"), F.lit(True).alias("tied"))
        each = graph.nodes.select("id", F.lit(1).alias("n"), F.lit(False).alias("tied")).unionByName(ends)
        held = graph.__dict__["_odd"] = rounds, rounds.hold(each.groupBy("id").agg(F.sum("n").alias("n"), F.bool_or("tied").alias("tied")).filter("n <> 1 or not tied"))
    return held[1]


def bad_ids(graph: Graph, grammar: str = r"^\S.*$") -> DataFrame:
    empty = graph.nodes.filter(F.col("id").isNull() | (F.col("id") == "") | ~F.col("id").rlike(grammar))
    twice = _odd(graph).filter("n > 1")
    return finding(empty, "ERROR", "NODE_ID", F.coalesce("id", F.lit(""))).unionByName(finding(twice, "ERROR", "DUPLICATE_ID", F.col("id")))


def dangling(graph: Graph) -> DataFrame:
    """Edges without one of their ends."""
    missing, found = _odd(graph).filter("n = 0 and id is not null").select("id"), [graph.edges.filter("src is null or dst is null")]
    if not missing.isEmpty():
        found += [graph.edges.join(missing, F.col(end) == F.col("id"), "left_semi") for end in ("src", "dst")]
    parts = [e.select(F.concat_ws(" ", "src", "type", "dst").alias("d")) for e in found]
    return finding(reduce(DataFrame.unionByName, parts).distinct(), "ERROR", "REFERENTIAL_INTEGRITY", F.col("d"))


def vocabulary(graph: Graph, labels: set[str], types: set[str]) -> DataFrame:
    l = graph.nodes.filter(~F.col("label").isin(*labels)).select("label").distinct()
    t = graph.edges.filter(~F.col("type").isin(*types)).select("type").distinct()
    return finding(l, "ERROR", "UNKNOWN_LABEL", F.col("label")).unionByName(finding(t, "ERROR", "UNKNOWN_TYPE", F.col("type")))


def required(graph: Graph, types: set[str]) -> DataFrame:
    want = graph.nodes.sparkSession.createDataFrame([(t,) for t in sorted(types)], "type string")
    return finding(want.join(graph.edges.select("type").distinct(), "type", "left_anti"), "WARNING", "REQUIRED_TYPE", F.col("type"))


def property_types(graph: Graph, kinds: dict[str, str]) -> DataFrame:
    """Properties, by name, whose text isn't of the type (long, double or boolean)."""
    each = graph.nodes.select("id", F.explode("props").alias("key", "value"))
    wrong = F.lit(False)
    for key, kind in kinds.items():
        wrong = wrong | ((F.col("key") == key) & F.col("value").try_cast(kind).isNull())
    return finding(each.filter(wrong), "WARNING", "PROPERTY_TYPE", F.concat_ws(" ", "id", "key", "value"))


def orphans(graph: Graph, tolerated: set[str] = frozenset()) -> DataFrame:
    nodes = graph.nodes.filter(~F.col("label").isin(*tolerated)) if tolerated else graph.nodes
    alone = nodes.join(_odd(graph).filter("n > 0 and not tied and id is not null").select("id"), "id", "left_semi").select("id")
    return finding(alone.unionByName(nodes.filter("id is null").select("id")), "WARNING", "ORPHAN", F.col("id"))


def provenance(graph: Graph) -> DataFrame:
    """Inferred edges without confidence; nodes by a language model without evidence."""
    e = graph.edges.filter((F.col("props")["origin"] == "inferred") & F.col("props")["confidence"].isNull())
    n = graph.nodes.filter((F.col("props")["origin"] == "llm") & F.col("props")["evidence"].isNull())
    return finding(e, "ERROR", "INFERRED_CONFIDENCE", F.concat_ws(" ", "src", "type", "dst")).unionByName(finding(n, "ERROR", "LLM_EVIDENCE", F.col("id")))


def below(ratio: DataFrame, column: str, gate: float, severity: str, rule: str) -> DataFrame:
    """A finding for each ratio under its gate."""
    return finding(ratio.filter(F.col(column) < gate), severity, rule, F.col(column))


def report(graph: Graph, checks: dict[str, Check]) -> tuple[DataFrame, DataFrame]:
    """Findings by severity and rule with at most 50 details, and the one-row status. A check that can't be planned
    is a warning itself."""
    parts = []
    spark = graph.nodes.sparkSession
    for name, check in checks.items():
        try:
            parts.append(check(graph))
        except Exception as e:
            if isinstance(e, Py4JJavaError) or isinstance(e, CapturedException) and not isinstance(e, AnalysisException):
                raise  # a job failed, so nothing is known of the graph
            parts.append(spark.createDataFrame([("WARNING", "RULE_ERROR", f"{name}: {type(e).__name__}")], "severity string, rule string, detail string"))
    # every check is run once: what comes of it is counted by detail and held
    every = Rounds(spark).hold(reduce(DataFrame.unionByName, parts).groupBy("severity", "rule", "detail").agg(F.count(F.lit(1)).alias("n")))
    # the first 50 of a rule are found before the shuffle, so a rule that hits many rows gathers no more than 50 a task
    first = F.row_number().over(Window.partitionBy("severity", "rule").orderBy("detail"))
    shown = every.filter("detail is not null").withColumn("_r", first).filter("_r <= 50").groupBy("severity", "rule").agg(F.array_sort(F.collect_list("detail")).alias("details"))
    found = every.groupBy("severity", "rule").agg(F.sum("n").alias("n")).join(shown, ["severity", "rule"], "left")
    found = found.select("severity", "rule", "n", F.coalesce("details", F.array().cast("array<string>")).alias("details"))
    rank = F.create_map(*[x for k, v in _RANK.items() for x in (F.lit(k), F.lit(v))])
    status = found.agg(F.min(rank[F.col("severity")]).alias("worst")).select(F.when(F.col("worst") == 0, "FAIL").when(F.col("worst") == 1, "WARN").otherwise("PASS").alias("status"))
    return found.orderBy(rank[F.col("severity")], "rule"), status
