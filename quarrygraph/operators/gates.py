"""Gates by dialect: what a graph of an estate has to have before its answers are trusted.

Each gate is a check of validate.report(): a function of a graph that gives findings (severity, rule, detail). Those that
need more than the graph are made by a function that takes it: files, objects, counts of the readers. Ratios are
one-row tables; a ratio of nothing passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .validate import Check, below, dangling, finding, required


def _p(key: str) -> Column:
    return F.col("props")[key]


def empty_names(graph: Graph) -> DataFrame:
    return finding(graph.nodes.filter(F.trim(F.coalesce("name", F.lit(""))) == ""), "WARNING", "EMPTY_NAME", F.col("id"))


def self_loops(graph: Graph) -> DataFrame:
    return finding(graph.edges.filter("src = dst"), "WARNING", "SELF_LOOP", F.concat_ws(" ", "src", "type"))


def lacking(label: str, types: list[str], severity: str, rule: str, end: str = "src", when: str = "true") -> Check:
    """Nodes of a label, and of a condition, that no edge of the types leaves (end src) or reaches (dst)."""
    return lambda g: finding(g.by_label(label).filter(when).join(g.of_type(*types).select(F.col(end).alias("id")), "id", "left_anti"), severity, rule, F.col("name"))


def having(label: str, severity: str, rule: str, when: Column | None = None) -> Check:
    """Nodes of a label and a condition."""
    return lambda g: finding(g.by_label(label).filter(when) if when is not None else g.by_label(label), severity, rule, F.col("name"))


def number(rows: DataFrame, severity: str, rule: str, when: str, what: str = "n") -> DataFrame:
    """One finding with the number of rows, if it meets a condition on n."""
    return finding(rows.agg(F.count(F.lit(1)).alias("n")).filter(when), severity, rule, F.concat_ws(" ", F.lit(what), F.col("n")))


def percent(rows: DataFrame, hit: Column) -> DataFrame:
    """One row, n and pct: how many of the rows hit, 100 where there are none."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hit")).select("n", F.when(F.col("n") == 0, 100.0).otherwise(F.round(100.0 * F.col("hit") / F.col("n"), 1)).alias("pct"))


def united(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


EXPECTED = {"CONTAINS_ACTIVITY", "TRANSITIONS_TO", "INVOKES", "CONFIGURED_BY", "USES_VARIABLE", "DEFINES", "EXPOSES"}


def integration(files: DataFrame | None = None, exported: tuple[DataFrame, DataFrame] | None = None) -> dict[str, Check]:
    """files: path, kind, supported and modelled (whether the graph has a node of it); exported: nodes and edges as written."""
    gates: dict[str, Check] = {
        "names": empty_names, "loops": self_loops, "types": lambda g: required(g, EXPECTED),
        "modules": lacking("Process", ["CONTAINS"], "ERROR", "PROCESS_WITHOUT_MODULE", "dst"),
        "work": lacking("Process", ["CONTAINS_ACTIVITY", "USES_XSD", "REFERENCES"], "WARNING", "PROCESS_WITHOUT_WORK"),
        "schemas": lacking("Schema", ["DEFINES"], "WARNING", "SCHEMA_WITHOUT_ELEMENTS"),
        "entries": lambda g: number(g.by_label("Activity").filter(F.lower(_p("starter")) == "true"), "WARNING", "NO_ENTRY_POINTS", "n = 0"),
        "external": having("ExternalReference", "WARNING", "EXTERNAL_REFERENCE"),
    }
    if files is not None:
        gates["resources"] = lambda g: finding(
            files.filter("kind = 'resource'").agg(F.count(F.lit(1)).alias("n")).crossJoin(g.by_label("SharedResource").agg(F.count(F.lit(1)).alias("made"))).filter("n > 0 and made = 0"),
            "ERROR", "RESOURCES_NOT_MODELLED", F.col("n"),
        )  # one row each
        gates["artifacts"] = lambda g: below(percent(files.filter("supported"), F.col("modelled")), "pct", 50.0, "WARNING", "ARTIFACT_COVERAGE")
    if exported is not None:
        gates["exported"] = lambda g: dangling(Graph(*exported)).withColumn("rule", F.lit("EXPORTED_ENDPOINT"))
    return gates


def application(resolved: DataFrame | None = None, parsed: DataFrame | None = None, unhandled: DataFrame | None = None, dictionary: bool = False) -> dict[str, Check]:
    """resolved: references with hit; parsed: statements with ok; unhandled: procedure and n; dictionary: whether one was read."""
    gates: dict[str, Check] = {
        "application": lambda g: united(number(g.by_label("Application"), "ERROR", "NO_APPLICATION", "n = 0"), number(g.by_label("Application"), "INFO", "SEVERAL_APPLICATIONS", "n > 1")),
        "pages": lacking("Page", ["CONTAINS", "CONTAINS_PAGE"], "ERROR", "PAGE_WITHOUT_APPLICATION", "dst"),
        "regions": lacking("Region", ["CONTAINS_REGION", "CONTAINS_SUBREGION", "CONTAINS"], "WARNING", "REGION_WITHOUT_PAGE", "dst"),
        "columns": lacking("DbColumn", ["HAS_COLUMN"], "ERROR", "COLUMN_WITHOUT_TABLE", "dst"),
        "dictionary": lambda g: number(g.by_label("Application").limit(0), "WARNING", "NO_DICTIONARY", f"{str(not dictionary).lower()}"),
    }
    if resolved is not None:
        gates["resolution"] = lambda g: below(percent(resolved, F.col("hit")), "pct", 80.0, "WARNING", "RESOLUTION")
    if parsed is not None:
        gates["parsing"] = lambda g: below(percent(parsed, F.col("ok")), "pct", 95.0, "WARNING", "PARSE_FAILURES")
    if unhandled is not None:
        gates["unhandled"] = lambda g: finding(unhandled, "WARNING", "UNHANDLED_PROCEDURE", F.concat_ws(" ", "procedure", "n"))
    if dictionary:
        gates["dependencies"] = undeclared_calls
    return gates


def undeclared_calls(graph: Graph) -> DataFrame:
    """Inferred calls between units that the dictionary has no dependency for."""
    calls = graph.of_type("CALLS").filter(_p("origin") == "inferred").select("src", "dst").distinct()
    return finding(calls.join(graph.of_type("DEPENDS_ON").select("src", "dst"), ["src", "dst"], "left_anti"), "WARNING", "UNDECLARED_CALL", F.concat_ws(" ", "src", "dst"))


def database(parsed: DataFrame | None = None, objects: DataFrame | None = None, resolved: DataFrame | None = None, entries: str = "lower(props['published']) = 'true'") -> dict[str, Check]:
    """parsed: statements with ok; objects: owner, name and kind as read from scripts; resolved: references with hit; entries: what an entry point is."""
    access = ["READS_FROM", "WRITES_TO", "INSERTS_INTO", "UPDATES", "DELETES_FROM"]
    gates: dict[str, Check] = {
        "functions": lacking("BusinessFunction", ["IMPLEMENTED_BY", "GROUNDED_IN", "REALISED_BY"], "ERROR", "UNGROUNDED_FUNCTION"),
        "tests": lambda g: lacking("DbProgramUnit", ["HAS_TEST", "TESTS"], "INFO", "UNTESTED_ENTRY_POINT", "src", entries)(Graph(g.nodes, g.edges.withColumn("src", F.when(F.col("type") == "TESTS", F.col("dst")).otherwise(F.col("src"))))),
        "loose": lambda g: finding(
            g.by_label("DbProgramUnit").join(g.of_type("DECLARES", "CONTAINS").select(F.col("dst").alias("id")), "id", "left_anti"), "ERROR", "LOOSE_UNIT", F.col("name")),
        "access": lambda g: finding(
            g.by_label("SqlStatement").agg(F.count(F.lit(1)).alias("n")).crossJoin(g.of_type(*access).agg(F.count(F.lit(1)).alias("made"))).filter("n > 0 and made = 0"), "ERROR", "NO_DATA_ACCESS", F.col("n")),
        "columns": lacking("DbTable", ["HAS_COLUMN"], "WARNING", "TABLE_WITHOUT_COLUMNS"),
        "invalid": lambda g: finding(g.nodes.filter(_p("status") == "INVALID"), "WARNING", "INVALID_OBJECT", F.col("name")),
        "dynamic": lambda g: number(g.by_label("DbProgramUnit").filter(F.lower(_p("dynamicSql")) == "true"), "INFO", "DYNAMIC_SQL", "n > 0"),
    }
    if parsed is not None:
        gates["parsing"] = lambda g: united(below(percent(parsed, F.col("ok")), "pct", 90.0, "WARNING", "PARSE_QUALITY"), number(parsed.filter(~F.col("ok")), "WARNING", "PARSE_FAILED", "n > 0"))
    if objects is not None:
        gates["scripts"] = lambda g: unparsed(objects)
        gates["bodies"] = lambda g: bodies_alone(objects)
    if resolved is not None:
        gates["resolution"] = lambda g: below(percent(resolved, F.col("hit")), "pct", 80.0, "WARNING", "RESOLUTION")
    return gates


def unparsed(objects: DataFrame) -> DataFrame:
    """How much of the scripts wasn't understood: a warning over a tenth of it."""
    share = percent(objects, F.col("kind") == "UNPARSED").filter("n > 0 and pct > 0")
    return share.select(F.when(F.col("pct") > 10, "WARNING").otherwise("INFO").alias("severity"), F.lit("UNPARSED_DDL").alias("rule"), F.col("pct").cast("string").alias("detail"))


def bodies_alone(objects: DataFrame) -> DataFrame:
    """Package and type bodies without their specification."""
    spec = objects.filter(F.col("kind").isin("PACKAGE", "TYPE")).select("owner", "name", F.concat("kind", F.lit("_BODY")).alias("kind"))
    body = objects.filter(F.col("kind").isin("PACKAGE_BODY", "TYPE_BODY"))
    return finding(body.join(spec, ["owner", "name", "kind"], "left_anti"), "ERROR", "BODY_WITHOUT_SPEC", F.concat_ws(".", "owner", "name"))


def federated(coverage: DataFrame | None = None, conflicts: DataFrame | None = None, issues: DataFrame | None = None, inputs: DataFrame | None = None, suppressed: DataFrame | None = None, merged: int | None = None, databases: int = 0) -> dict[str, Check]:
    """coverage: the row of links.bind_coverage(); conflicts: of merge, with how; issues: with rule; inputs: estate, measure, value and gate;
    suppressed: of links.cross_estate(); merged: nodes that several estates share; databases: estates that have a database."""
    gates: dict[str, Check] = {
        "estates": lambda g: finding(g.nodes.filter(F.coalesce(_p("estate"), _p("estates")).isNull()), "ERROR", "NODE_WITHOUT_ESTATE", F.col("id")),
        "crossing": lambda g: number(crossing(g), "WARNING", "NOTHING_CROSSES", f"n = 0 and {merged or 0} = 0"),
    }
    if coverage is not None:
        gates["bind"] = lambda g: below(coverage, "sql_bind", 80.0, "WARNING", "BIND_COVERAGE")
        gates["datasources"] = lambda g: below(coverage, "datasource", 80.0, "WARNING", "DATASOURCE_COVERAGE")
    if merged is not None:
        gates["merges"] = lambda g: number(g.nodes.limit(0), "WARNING", "NO_MERGES", str(databases >= 2 and merged == 0).lower())
    if conflicts is not None:
        gates["conflicts"] = lambda g: finding(conflicts.filter("how = 'order'"), "WARNING", "SETTLED_BY_ORDER", F.col("id"))
    if issues is not None:
        gates["rules"] = lambda g: finding(issues.filter(~F.col("rule").contains(":") & ~F.col("rule").rlike("^[A-Z]-")).select("rule").distinct(), "ERROR", "RULE_WITHOUT_ESTATE", F.col("rule"))
    if inputs is not None:
        gates["inputs"] = lambda g: finding(inputs.filter("value < gate"), "WARNING", "INPUT_BELOW_GATE", F.concat_ws(" ", "estate", "measure", "value"))
    if suppressed is not None:
        gates["suppressed"] = lambda g: number(suppressed, "INFO", "SUPPRESSED_MATCHES", "n > 0")
    return gates


def crossing(graph: Graph) -> DataFrame:
    """Edges between nodes of different estates."""
    of = graph.nodes.select("id", _p("estate").alias("estate"))
    a, b = of.select(F.col("id").alias("src"), F.col("estate").alias("a")), of.select(F.col("id").alias("dst"), F.col("estate").alias("b"))
    return graph.edges.join(a, "src").join(b, "dst").filter("a <> b")


ALL = {"integration": integration, "application": application, "database": database, "federated": federated}
