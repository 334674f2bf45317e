"""python -m quarrygraph COMMAND ...: analyze, federate, validate, rules, impact, inventory, search, diff, queries."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import Graph, resolve
from .operators import gates, inventory, merge, rules, search, traverse, validate
from .plans import catalog, cookbook, render
from .sources import application, database, files, integration

_READ = {"database": database.database_graph, "application": application.application_graph, "integration": integration.integration_graph}
_WEIGHTS = {"database": database.WEIGHTS, "application": application.WEIGHTS, "integration": integration.WEIGHTS}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: a wrong request; 2: a gate that failed."""
    a = argparse.ArgumentParser(prog="quarrygraph")
    sub = a.add_subparsers(dest="command", required=True)
    c = sub.add_parser("analyze")
    c.add_argument("kind", choices=_READ)
    c.add_argument("root")
    c.add_argument("out")
    c = sub.add_parser("federate")
    c.add_argument("out")
    c.add_argument("estates", nargs="+", help="name=graph")
    for name in ("validate", "rules", "impact", "inventory", "search", "diff", "queries"):
        c = sub.add_parser(name)
        c.add_argument("graph")
        if name == "validate":
            c.add_argument("--dialect", choices=gates.ALL)
            c.add_argument("--strict", action="store_true")
        if name == "rules":
            c.add_argument("--catalogue", choices=catalog.ALL, default="database")
            c.add_argument("--severity", choices=rules.SEVERITIES, default="INFO")
            c.add_argument("--category")
            c.add_argument("--fail-on", choices=rules.SEVERITIES)
        if name == "impact":
            c.add_argument("target")
            c.add_argument("--kind", choices=_WEIGHTS, default="database")
            c.add_argument("--direction", choices=["up", "down", "both"], default="up")
            c.add_argument("--depth", type=int, default=8)
            c.add_argument("--all-matches", action="store_true")
            c.add_argument("--fail-on", choices=["LOW", "MEDIUM", "HIGH", "CRITICAL"])
        if name == "search":
            c.add_argument("query")
        if name == "diff":
            c.add_argument("baseline")
        if name == "queries":
            c.add_argument("name", nargs="?")
            c.add_argument("arguments", nargs="*")
    o = a.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarrygraph").getOrCreate()
    show = lambda df: print(render.markdown_table(df))
    if o.command == "analyze":
        found = files.scan(spark, o.root).filter("skip is null")
        g = _READ[o.kind](found.select("path", "kind", "text"))
        g.save(o.out)
        show(inventory.label_counts(g).orderBy("label"))
        return 0
    if o.command == "federate":
        g, conflicts = merge.federated([(e.partition("=")[0], Graph.load(spark, e.partition("=")[2])) for e in o.estates])
        g.save(o.out)
        show(conflicts)
        return 0
    g = Graph.load(spark, o.graph)
    if o.command == "validate":
        report, status = validate.report(g, {"ids": validate.bad_ids, "ends": validate.dangling, "orphans": validate.orphans, "provenance": validate.provenance, **(gates.ALL[o.dialect]() if o.dialect else {})})
        show(report)
        s = status.first()["status"] or "PASS"
        print(s)
        return 2 if s == "FAIL" or o.strict and s == "WARN" else 0
    if o.command == "rules":
        found = rules.issues(g, catalog.ALL[o.catalogue]())
        show(rules.filtered(found, o.severity, o.category))
        return 2 if o.fail_on and not rules.filtered(found, o.fail_on).isEmpty() else 0
    if o.command == "impact":
        hits = [r["id"] for r in resolve(g, o.target).limit(50).collect()]
        if not hits or len(hits) > 1 and not o.all_matches:
            print(f"{o.target}: {'names nothing' if not hits else 'names ' + ', '.join(hits)}", file=sys.stderr)
            return 1
        reached = traverse.blast_radius(g, hits, o.direction, o.depth, _WEIGHTS[o.kind], database.STRUCTURAL)
        show(traverse.impact_rows(g, reached))
        summary = traverse.risk_summary(g, reached, {}, F.col("label").isin("Page", "Process", "DbTrigger"))
        show(summary)
        order = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
        return 2 if o.fail_on and order.index(summary.first()["band"]) >= order.index(o.fail_on) else 0
    if o.command == "inventory":
        for rows in (inventory.label_counts(g).orderBy(F.desc("n"), "label"), inventory.type_counts(g).orderBy(F.desc("n"), "type"), inventory.hotspots(g)):
            show(rows)
    elif o.command == "search":
        docs = g.nodes.select(F.col("id").alias("doc"), "name", F.array_join(F.map_values("props"), " ").alias("body"))
        show(search.bm25(search.index(docs, {"body": 1.0, "name": 3.0}), search.query_terms(spark, o.query), 20))
    elif o.command == "diff":
        show(merge.diff(Graph.load(spark, o.baseline).nodes, g.nodes.select("id", "label", "name"), "id", ["label", "name"]))
    elif not o.name:
        print("\n".join(cookbook.COOKBOOK))
    else:
        found = [f for k, f in cookbook.COOKBOOK.items() if o.name.lower() in k.lower()]
        if len(found) != 1:
            return 1
        show(found[0](g, *o.arguments))
    return 0


if __name__ == "__main__":
    sys.exit(main())
