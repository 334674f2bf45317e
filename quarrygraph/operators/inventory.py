"""Counts, rankings and lists that describe a graph. Lists of names are sorted sets; every ranking ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph


def names(col: str | Column) -> Column:
    """A sorted set."""
    return F.array_sort(F.collect_set(col))


def label_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def hotspots(graph: Graph, types: list[str] | None = None, excluded: list[str] | None = None, limit: int = 25) -> DataFrame:
    """The nodes with most incoming edges: id, label, dependents, kinds."""
    e = graph.of_type(*types) if types else graph.edges
    if excluded:
        e = e.filter(~F.col("type").isin(*excluded))
    top = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"), names("type").alias("kinds"))
    return top.join(graph.nodes.select("id", "label"), "id").orderBy(F.desc("dependents"), "id").limit(limit)


def unreferenced(graph: Graph, label: str, types: list[str], incoming: bool = True) -> DataFrame:
    """Nodes of a label that no edge of the types touches on that side."""
    end = "dst" if incoming else "src"
    return graph.by_label(label).join(graph.of_type(*types).select(F.col(end).alias("id")), "id", "left_anti")


def entry_points(graph: Graph, predicate: Column) -> DataFrame:
    return graph.nodes.filter(predicate).select("id", "label", "name")


def edge_profile(graph: Graph, label: str, types: dict[str, str], limit: int | None = None) -> DataFrame:
    """For nodes of a label, how many outgoing edges of each type (type -> column name), most in all first."""
    e = graph.of_type(*types)
    counts = e.groupBy(F.col("src").alias("id")).agg(*[F.count_if(F.col("type") == t).alias(c) for t, c in types.items()])
    out = graph.by_label(label).select("id", "name").join(counts, "id", "left").na.fill(0)
    out = out.withColumn("total", sum((F.col(c) for c in types.values()), F.lit(0)))
    return out.orderBy(F.desc("total"), "id").limit(limit) if limit else out


def access_matrix(access: DataFrame, row: str, column: str, verb: str, writes: list[str]) -> DataFrame:
    """One row for each pair, with its verbs and whether any of them writes."""
    return access.groupBy(row, column).agg(names(verb).alias("verbs"), F.bool_or(F.col(verb).isin(*writes)).alias("write"))


def access_by_estate(access: DataFrame) -> DataFrame:
    """For (table, estate, write): the estates that write and read each table, and how often."""
    return access.groupBy("table").agg(
        names(F.when(F.col("write"), F.col("estate"))).alias("writers"), names(F.when(~F.col("write"), F.col("estate"))).alias("readers"),
        F.count_if(F.col("write")).alias("n_writes"), F.count_if(~F.col("write")).alias("n_reads"),
    )


def contended(access: DataFrame, least: int = 2) -> DataFrame:
    """Tables that several estates write."""
    return access_by_estate(access).filter(F.size("writers") >= least)


def boundary(links: DataFrame) -> DataFrame:
    """For (component, target_estate, access, confidence): what each component reaches outside its own estate, and the least confidence."""
    return links.groupBy("component").agg(names("target_estate").alias("reaches"), names("access").alias("access"), F.coalesce(F.min("confidence"), F.lit(1.0)).alias("confidence"))


def module_metrics(members: DataFrame, module: str, conditions: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    return members.groupBy(module).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()], *[F.round(F.sum(c), 1).alias(n) for n, c in sums.items()])


def module_dependencies(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """Distinct pairs of different modules whose members are joined by an edge; module_of is (id, module)."""
    a, b = (module_of.select(F.col("id").alias(end), F.col("module").alias(name)) for end, name in (("src", "module"), ("dst", "depends_on")))
    return edges.join(a, "src").join(b, "dst").filter("module <> depends_on").select("module", "depends_on").distinct()


def partners(pairs: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """Sets of members that groups have, of least members or more, and how many groups have each."""
    sets = pairs.groupBy(group).agg(names(member).alias("members")).filter(F.size("members") >= least)
    return sets.groupBy("members").agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """Share of rows that hit, in percent with one decimal; 100 for nothing."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("coverage", F.when(F.col("n") == 0, F.lit(100.0)).otherwise(F.round(100.0 * F.col("hits") / F.col("n"), 1)))


def nth(rows: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Each row's number among those that are equal in some columns."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def following(rows: DataFrame, by: list[str], order: list[str], of: str, name: str = "next") -> DataFrame:
    """The value of the next row of the same group."""
    return rows.withColumn(name, F.lead(of).over(Window.partitionBy(*by).orderBy(*order)))


def issue_summary(issues: DataFrame, keys: list[str]) -> DataFrame:
    return issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def churn(changes: DataFrame, complexity: DataFrame, limit: int = 25) -> DataFrame:
    """id with its changes times its complexity, highest first; both are (id, value)."""
    a, b = changes.groupBy("id").agg(F.count(F.lit(1)).alias("changes")), complexity.groupBy("id").agg(F.sum("value").alias("complexity"))
    return a.join(b, "id").withColumn("risk", F.col("changes") * F.col("complexity")).orderBy(F.desc("risk"), "id").limit(limit)
