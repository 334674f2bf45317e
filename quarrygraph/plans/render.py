"""Texts for people and other programs: diagrams, packs, CSV and statements. Rows are bounded by limits, which belong to the
picture, and are collected only here."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import inventory


def _safe(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "_" for c in text)


def mermaid(edges: DataFrame, limit: int = 60, title: str = "") -> str:
    """A flow chart of rows (a, b, label), in their order."""
    lines = [f"%% {title}"] if title else []
    lines.append("flowchart LR")
    for r in edges.limit(limit).collect():
        lines.append(f'  {_safe(r["a"])}["{r["a"]}"] -->|{r["label"]}| {_safe(r["b"])}["{r["b"]}"]')
    return "\n".join(lines) + "\n"


def plantuml(edges: DataFrame, limit: int = 60, title: str = "") -> str:
    lines = ["@startuml", *([f"title {title}"] if title else [])]
    for r in edges.limit(limit).collect():
        lines.append(f'[{r["a"]}] --> [{r["b"]}] : {r["label"]}')
    return "\n".join([*lines, "@enduml"]) + "\n"


def named_edges(graph: Graph, *types: str) -> DataFrame:
    """Edges of some types as rows (a, b, label) of names, in the order of names."""
    n = graph.nodes.select("id", "name")
    e = (graph.of_type(*types) if types else graph.edges).join(n.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return e.select("a", "b", F.col("type").alias("label")).distinct().orderBy("a", "b", "label")


def entity_relations(graph: Graph, limit: int = 40) -> str:
    """Tables with their columns and what they refer to."""
    col = graph.of_type("HAS_COLUMN").select("src", "dst").join(graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("column"), F.col("props")["dataType"].alias("type")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("column", "type"))).alias("columns"))
    rows = graph.by_label("DbTable").join(col, "id", "left").select("name", "columns").orderBy("name").limit(limit).collect()
    lines = ["erDiagram"]
    for r in rows:
        lines += [f"  {_safe(r['name'])} {{", *(f"    {_safe(c['type'] or 'ANY')} {_safe(c['column'])}" for c in r["columns"] or []), "  }"]
    lines += [f'  {_safe(e["a"])} }}o--|| {_safe(e["b"])} : ""' for e in named_edges(graph, "REFERENCES_TABLE").limit(limit).collect()]
    return "\n".join(lines) + "\n"


def markdown_table(rows: DataFrame, limit: int = 50) -> str:
    head = rows.columns
    cell = lambda v: ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v).replace("|", "\\|")
    body = [f"| {' | '.join(cell(r[c]) for c in head)} |" for r in rows.limit(limit).collect()]
    return "\n".join([f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *body]) + "\n"


def pack(title: str, coverage: DataFrame, sections: dict[str, DataFrame], limit: int = 50) -> str:
    """A document of tables whose first is how much of the estate is known."""
    parts = [f"# {title}\n", "## Coverage\n", markdown_table(coverage)]
    for name, rows in sections.items():
        parts += [f"## {name}\n", markdown_table(rows, limit)]
    return "\n".join(parts)


def facts(sections: dict[str, DataFrame], limit: int = 1000) -> str:
    """The sections as one JSON document with sorted keys."""
    rows = {k: [json.loads(r[0]) for r in df.limit(limit).select(F.to_json(F.struct("*"))).collect()] for k, df in sections.items()}
    return json.dumps(rows, indent=2, sort_keys=True)


def cypher(graph: Graph) -> DataFrame:
    """One statement a row, in the order in which to run them: nodes by label and id, then edges by type and ends."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    entries = F.array_sort(F.map_entries("props"))
    props = lambda: F.array_join(F.transform(entries, lambda e: F.concat(F.lit("`"), e["key"], F.lit("`: "), quote(e["value"]))), ", ")
    nodes = graph.nodes.select(F.lit(0).alias("part"), F.col("label").alias("k1"), F.col("id").alias("k2"), F.lit("").alias("k3"), F.concat(F.lit("MERGE (n:`"), "label", F.lit("` {nodeId: "), quote(F.col("id")), F.lit("}) SET n.name = "), quote(F.col("name")), F.lit(", n += {"), props(), F.lit("};")).alias("statement"))
    edges = graph.edges.select(F.lit(1).alias("part"), F.col("type").alias("k1"), F.col("src").alias("k2"), F.col("dst").alias("k3"), F.concat(F.lit("MATCH (a {nodeId: "), quote(F.col("src")), F.lit("}), (b {nodeId: "), quote(F.col("dst")), F.lit("}) MERGE (a)-[r:`"), "type", F.lit("`]->(b) SET r += {"), props(), F.lit("};")).alias("statement"))
    return nodes.unionByName(edges).orderBy("part", "k1", "k2", "k3").select("statement")


def constraints(graph: Graph) -> DataFrame:
    """Uniqueness statements of the labels that there are."""
    return inventory.label_counts(graph).select(F.concat(F.lit("CREATE CONSTRAINT IF NOT EXISTS FOR (n:`"), "label", F.lit("`) REQUIRE n.nodeId IS UNIQUE;")).alias("statement")).orderBy("statement")


def node_csv(graph: Graph, kinds: dict[str, str] | None = None) -> DataFrame:
    """Nodes as one wide table: nodeId, labels, name, and a column for every property, with `:int`, `:float` or `:boolean` behind its name."""
    keys = [r[0] for r in graph.nodes.select(F.explode(F.map_keys("props")).alias("k")).distinct().orderBy("k").collect()]  # the vocabulary of a graph
    typed = lambda k: f"{k}:{kinds[k]}" if kinds and k in kinds else k
    return graph.nodes.select(F.col("id").alias("nodeId:ID"), F.col("label").alias(":LABEL"), "name", *[(F.lower(F.col("props")[k]) if kinds and kinds.get(k) == "boolean" else F.col("props")[k]).alias(typed(k)) for k in keys])


def graph_json(graph: Graph) -> DataFrame:
    """Nodes and relationships as one JSON line each, with a kind."""
    n = graph.nodes.select(F.lit("node").alias("kind"), "ordinal", F.to_json(F.struct("id", "label", "name", F.col("props").alias("properties"))).alias("json"))
    e = graph.edges.select(F.lit("relationship").alias("kind"), "ordinal", F.to_json(F.struct(F.col("src").alias("start"), F.col("dst").alias("end"), "type", F.col("props").alias("properties"))).alias("json"))
    return n.unionByName(e)


def read_csv(spark, path: str) -> DataFrame:
    """A table whose headers are name:type, each value cast to its type, or null where it isn't of it."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    kinds = {"int": "bigint", "float": "double", "boolean": "boolean"}
    out = []
    for c in raw.columns:
        name, _, kind = c.partition(":")
        col = F.col(f"`{c}`")
        out.append((col.try_cast(kinds[kind]) if kind in kinds else col).alias(name or kind))
    return raw.select(*out)


def push(graph: Graph, send, batch: int = 1000) -> None:
    """Give nodes, then edges, to send(kind, rows) in batches, from the tasks; a batch that is sent again must do no harm, as with MERGE."""

    def each(kind: str):
        def run(rows) -> None:
            held = []
            for r in rows:
                held.append(r.asDict(recursive=True))
                if len(held) == batch:
                    send(kind, held)
                    held = []
            if held:
                send(kind, held)

        return run

    graph.nodes.foreachPartition(each("node"))
    graph.edges.foreachPartition(each("edge"))
