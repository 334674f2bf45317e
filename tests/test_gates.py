"""Gates by dialect on small graphs in which each finds something, and on ones where none does."""

from quarrygraph.model import EDGES, NODES, Graph
from quarrygraph.operators import gates, validate


def graph(spark, nodes, edges=()):
    n = [(i, label, name, props, k) for k, (i, label, name, props) in enumerate(nodes)]
    e = [(s, d, t, p, k) for k, (s, d, t, *p) in enumerate(edges) for p in [p[0] if p else {}]]
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def found(g, checks):
    parts = gates.united(*(c(g) for c in checks.values()))
    return {(r.severity[0], r.rule, r.detail) for r in parts.collect()}


def test_integration(spark):
    g = graph(spark, [("m", "Module", "m", {}), ("p", "Process", "p", {}), ("q", "Process", " ", {}), ("s", "Schema", "s", {}), ("x", "ExternalReference", "gone", {})], [("m", "p", "CONTAINS"), ("p", "p", "INVOKES"), ("p", "s", "USES_XSD")])
    files = spark.createDataFrame([("a", "resource", True, False), ("b", "process", True, True), ("c", "x", True, False), ("d", "y", False, False)], "path string, kind string, supported boolean, modelled boolean")
    exported = g.nodes.select("id"), spark.createDataFrame([("p", "none", "INVOKES")], "src string, dst string, type string")
    assert found(g, gates.integration(files, exported)) == {
        ("W", "EMPTY_NAME", "q"), ("W", "SELF_LOOP", "p INVOKES"), ("E", "PROCESS_WITHOUT_MODULE", " "), ("W", "PROCESS_WITHOUT_WORK", " "), ("W", "SCHEMA_WITHOUT_ELEMENTS", "s"), ("W", "NO_ENTRY_POINTS", "n 0"),
        ("W", "EXTERNAL_REFERENCE", "gone"), ("E", "RESOURCES_NOT_MODELLED", "1"), ("W", "ARTIFACT_COVERAGE", "33.3"), ("E", "EXPORTED_ENDPOINT", "p INVOKES none"),
    } | {("W", "REQUIRED_TYPE", t) for t in gates.EXPECTED - {"INVOKES"}}


def test_application(spark):
    none = graph(spark, [("g", "Page", "g", {}), ("r", "Region", "r", {}), ("c", "DbColumn", "c", {})], [("u", "v", "CALLS", {"origin": "inferred"}), ("u", "w", "CALLS", {"origin": "inferred"}), ("u", "w", "DEPENDS_ON")])
    hits = spark.createDataFrame([(True,), (False,)], "hit boolean")
    odd = spark.createDataFrame([("proc", 3)], "procedure string, n long")
    got = found(none, gates.application(hits, hits.toDF("ok"), odd, True))
    assert got == {
        ("E", "NO_APPLICATION", "n 0"), ("E", "PAGE_WITHOUT_APPLICATION", "g"), ("W", "REGION_WITHOUT_PAGE", "r"), ("E", "COLUMN_WITHOUT_TABLE", "c"),
        ("W", "RESOLUTION", "50.0"), ("W", "PARSE_FAILURES", "50.0"), ("W", "UNHANDLED_PROCEDURE", "proc 3"), ("W", "UNDECLARED_CALL", "u v"),
    }
    two = graph(spark, [("a", "Application", "a", {}), ("b", "Application", "b", {}), ("g", "Page", "g", {})], [("a", "g", "CONTAINS")])
    assert found(two, gates.application()) == {("I", "SEVERAL_APPLICATIONS", "n 2"), ("W", "NO_DICTIONARY", "n 0")}


def test_database(spark):
    g = graph(spark, [("t", "DbTable", "t", {"status": "INVALID"}), ("u", "DbProgramUnit", "u", {"dynamicSql": "true", "published": "true"}), ("v", "DbProgramUnit", "v", {"published": "true"}), ("k", "DbPackage", "k", {}), ("q", "SqlStatement", "q", {}), ("f", "BusinessFunction", "f", {})], [("k", "v", "DECLARES"), ("x", "v", "TESTS")])
    objects = spark.createDataFrame([("A", "P", "PACKAGE_BODY"), ("A", "Q", "PACKAGE_BODY"), ("A", "Q", "PACKAGE"), ("A", "P", "TYPE"), ("A", "?", "UNPARSED")], "owner string, name string, kind string")
    parsed, hits = spark.createDataFrame([(True,), (False,)], "ok boolean"), spark.createDataFrame([(False,)], "hit boolean")
    assert found(g, gates.database(parsed, objects, hits)) == {
        ("E", "UNGROUNDED_FUNCTION", "f"), ("I", "UNTESTED_ENTRY_POINT", "u"), ("E", "LOOSE_UNIT", "u"), ("E", "NO_DATA_ACCESS", "1"), ("W", "TABLE_WITHOUT_COLUMNS", "t"), ("W", "INVALID_OBJECT", "t"), ("I", "DYNAMIC_SQL", "n 1"),
        ("W", "PARSE_QUALITY", "50.0"), ("W", "PARSE_FAILED", "n 1"), ("W", "UNPARSED_DDL", "20.0"), ("E", "BODY_WITHOUT_SPEC", "A.P"), ("W", "RESOLUTION", "0.0"),
    }


def test_federated(spark):
    g = graph(spark, [("a", "X", "a", {"estate": "one"}), ("b", "X", "b", {"estate": "two"}), ("c", "X", "c", {})], [("a", "a", "T")])
    one = lambda row, schema: spark.createDataFrame([row], schema)
    got = found(g, gates.federated(one((70.0, 60.0), "sql_bind double, datasource double"), one(("i", "order"), "id string, how string"), one(("plain",), "rule string"), one(("one", "resolution", 70.0, 80.0), "estate string, measure string, value double, gate double"), one(("s",), "src string"), 0, 2))
    assert got == {
        ("E", "NODE_WITHOUT_ESTATE", "c"), ("W", "NOTHING_CROSSES", "n 0"), ("W", "BIND_COVERAGE", "70.0"), ("W", "DATASOURCE_COVERAGE", "60.0"), ("W", "NO_MERGES", "n 0"), ("W", "SETTLED_BY_ORDER", "i"),
        ("E", "RULE_WITHOUT_ESTATE", "plain"), ("W", "INPUT_BELOW_GATE", "one resolution 70.0"), ("I", "SUPPRESSED_MATCHES", "n 1"),
    }
    linked = Graph(g.nodes.filter("id <> 'c'"), spark.createDataFrame([("a", "b", "T", {}, 0)], EDGES))
    assert found(linked, gates.federated()) == set()


def test_report_shows_fifty(spark):
    g = graph(spark, [(f"n{k:03}", "X", "", {}) for k in range(70)])
    rows, status = validate.report(g, {"names": gates.empty_names})
    r = rows.first()
    assert (r.n, len(r.details), r.details[0]) == (70, 50, "n000") and status.first()["status"] == "WARN"
