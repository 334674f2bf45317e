"""Sinks, renderings and commands."""

from quarrygraph.__main__ import main
from quarrygraph.model import EDGES, NODES, Graph
from quarrygraph.plans import render


def graph(spark):
    return Graph(
        spark.createDataFrame([("t", "DbTable", "T", {"n": "1", "on": "TRUE"}, 0), ("u", "DbProgramUnit", "U'x", {"dynamicSql": "true"}, 1), ("c", "DbColumn", "C", {"dataType": "NUMBER"}, 2)], NODES),
        spark.createDataFrame([("u", "t", "WRITES_TO", {}, 0), ("t", "c", "HAS_COLUMN", {}, 1)], EDGES),
    )


def test_texts(spark):
    g = graph(spark)
    assert 'T["T"]' in render.mermaid(render.named_edges(g, "WRITES_TO")) and "[U'x] --> [T]" in render.plantuml(render.named_edges(g))
    assert "NUMBER C" in render.entity_relations(g) and "DbTable" in [r.statement for r in render.constraints(g).collect()][2]
    statements = [r.statement for r in render.cypher(g).collect()]
    assert len(statements) == 5 and "U\\'x" in "".join(statements) and statements[-1].startswith("MATCH")
    assert "| n |" in render.pack("P", spark.sql("select 1 as n"), {"S": spark.sql("select 'a|b' as x")}) and '"S"' in render.facts({"S": spark.sql("select 1 as x")})


def test_round_trips(spark, tmp_path):
    g = graph(spark)
    path = str(tmp_path / "csv")
    render.node_csv(g, {"n": "int", "on": "boolean"}).write.csv(path, header=True)
    back = {r["ID" if "ID" in r.asDict() else "nodeId"]: r for r in render.read_csv(spark, path).collect()}
    assert back["t"]["n"] == 1 and back["t"]["on"] is True and back["u"]["n"] is None
    g.save(str(tmp_path / "g"))
    assert {r.id for r in Graph.load(spark, str(tmp_path / "g")).nodes.collect()} == {"t", "u", "c"} and render.graph_json(g).count() == 5
    doc = '{"schemaVersion": "1", "nodes": [{"id": "a", "label": "L", "name": "A", "properties": {"k": "v", "e": ""}}], "relationships": [{"start": "a", "end": "a", "type": "T", "properties": {}}]}'
    (tmp_path / "graph.json").write_text(doc)
    j = Graph.from_json(spark, str(tmp_path / "graph.json"))
    assert j.nodes.first().props == {"k": "v"} and j.edges.count() == 1


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.sql").write_text("create table people (id number);\ncreate view v as select id from people;\n")
    (tmp_path / "src" / "b.pkb").write_text("create or replace package body k as procedure p is begin execute immediate 'x' || y; delete from people; end p; end k;\n/\n")
    out = str(tmp_path / "g")
    assert main(["analyze", "database", str(tmp_path / "src"), out], spark) == 0
    assert main(["rules", out, "--fail-on", "CRITICAL"], spark) == 2 and "O-SEC-001" in capsys.readouterr().out
    assert main(["impact", out, "PEOPLE"], spark) == 0 and "db:APP.V" in capsys.readouterr().out
    assert main(["impact", out, "nothing such"], spark) == 1
