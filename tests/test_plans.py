"""Operators on small graphs against plain versions, and the cookbook and catalogues on a graph of every kind."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrygraph.model import EDGES, NODES, Graph, resolve
from quarrygraph.operators import merge, rules, search, traverse, validate
from quarrygraph.plans import text
from quarrygraph.plans.catalog import ALL
from quarrygraph.plans.cookbook import COOKBOOK


def plain_blast(edges, target, depth, weights):
    """Best first, by the contract."""
    import heapq

    best, done, heap = {target: (1.0, 0)}, set(), [(-1.0, 0, target)]
    while heap:
        w, hops, node = heapq.heappop(heap)
        if node in done or (-w, hops) != best[node]:
            continue
        done.add(node)
        if hops >= depth:
            continue
        for s, d, t in edges:
            if d == node and s != d and s != target:
                x = -w * weights[t] * 0.75
                if x >= 0.01 and (s not in best or x > best[s][0] + 1e-9):
                    best[s] = (x, hops + 1)
                    heapq.heappush(heap, (-x, hops + 1, s))
    return best


def test_blast_radius(spark):
    weights = {"A": 0.91, "B": 0.73, "C": 0.37}
    for seed in range(3):
        rng = random.Random(seed)
        n = rng.randrange(6, 20)
        edges = list({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("ABC")) for _ in range(3 * n)})
        g = Graph(spark.createDataFrame([(f"n{i}", "X", f"n{i}", {}, i) for i in range(n)], NODES), spark.createDataFrame([(*e, {}, i) for i, e in enumerate(edges)], EDGES))
        got = {r.id: (round(r.weight, 9), r.hops) for r in traverse.blast_radius(g, ["n0"], "up", 3, weights).collect()}
        assert {k: w for k, (w, _) in got.items()} == {k: round(w, 9) for k, (w, _) in plain_blast(edges, "n0", 3, weights).items()}


def test_waves_and_cycles(spark):
    nodes = spark.createDataFrame([(c, i) for i, c in enumerate("abcde")], "id string, ordinal long")
    need = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "src string, dst string")
    assert {r.id: r.wave for r in traverse.waves(nodes, need).collect()} == {"e": 1, "a": 2, "d": 3, "b": 4, "c": 5}
    assert {(r.id, r.component) for r in traverse.cycle_members(need).collect()} == {("b", "b"), ("c", "b")}


def test_policies_and_resolve(spark):
    nodes = spark.createDataFrame([("1", "A", "x", {"path": "a/x.sql"}, 0), ("1", "A", "y", {}, 1), ("2", "B", "x", {"code": "K7"}, 2)], NODES)
    edges = spark.createDataFrame([("1", "2", "T", {"k": "1"}, 0), ("1", "2", "T", {"k": "2"}, 1), ("1", "1", "T", {}, 2), ("1", "9", "T", {}, 3)], EDGES)
    g = Graph(nodes, edges)
    assert [r.name for r in g.deduplicated("first").by_label("A").collect()] == ["x"] and [r.name for r in g.deduplicated("last").by_label("A").collect()] == ["y"]
    assert g.deduplicated(dangling=False).edges.count() == 1 and g.deduplicated(parallel=True, loops=True).edges.count() == 4
    first = g.deduplicated()
    assert {r.id for r in resolve(first, "x").collect()} == {"1", "2"} and [r.id for r in resolve(first, "B:x").collect()] == ["2"]
    assert [r.id for r in resolve(first, "k7").collect()] == ["2"] and [r.id for r in resolve(first, "x.sql").collect()] == ["1"]


def test_merge(spark):
    c = spark.createDataFrame(
        [("db:T", "Table", "T", {"origin": "ddl", "rows": "1", "a": "x"}, 0, "one", 0), ("db:T", "View", "T", {"origin": "dictionary", "rows": "2", "b": ""}, 0, "two", 1), ("db:T", "Table", "T", {"rows": "3", "c": "z"}, 0, "three", 2)],
        NODES + ", estate string, rank int",
    )
    nodes, lost = merge.merge_nodes(c)
    n = nodes.first()
    assert (n.label, n.props, n.estates) == ("Table", {"a": "x", "c": "z", "rows": "2"}, ["one", "three", "two"])
    assert {(r.key, r.kept, r.lost, r.resolved_by) for r in lost.collect()} == {("rows", "2", "1", "authority"), ("rows", "2", "3", "authority"), ("label", "Table", "View", "first")}


def test_federated_rules_and_questions(spark):
    def estate(table, *statements):
        n = [("db:T", "DbTable", "T", {}), ("db:" + table, "DbTable", table, {}), *((s, "SqlStatement", s, {"verb": "UPDATE"}) for s in statements), ("issue:1", "Issue", "bad", {"rule": "R-1", "severity": "HIGH", "category": "data"})]
        e = [(s, t, "WRITES_TO", {}, k) for k, s in enumerate(statements) for t in ("db:T", "db:" + table)]
        return Graph(spark.createDataFrame([(*r, k) for k, r in enumerate(n)], NODES), spark.createDataFrame(e, EDGES))

    g, _ = merge.federated([("one", estate("A", "sql:1", "sql:2")), ("two", estate("B", "sql:1"))])
    assert g.nodes.columns == ["id", "label", "name", "props", "ordinal"] and g.edges.columns == ["src", "dst", "type", "props", "ordinal"]
    assert {r.id: (r.props["estate"], r.props["estates"]) for r in g.by_label("DbTable").collect()} == {"db:T": ("one", "one;two"), "db:A": ("one", "one"), "db:B": ("two", "two")}
    found = {(r.rule, r.target, r.message) for r in rules.issues(g, ALL["federated"]()).collect()}
    assert {("X-001", "db:T", "one, two"), ("X-004", "one/sql:1", "one, two")} == {f for f in found if f[0] in ("X-001", "X-004")}
    ask = {f.__name__[:3]: f for f in COOKBOOK.values()}
    assert {(r.estate, r.label, r.n) for r in ask["e01"](g).collect()} == {("one", "DbTable", 2), ("one", "SqlStatement", 2), ("one", "Issue", 1), ("two", "DbTable", 1), ("two", "SqlStatement", 1), ("two", "Issue", 1)}
    assert [(r.table, list(r.writers)) for r in ask["e03"](g).collect()] == [("db:T", ["one", "two"])]
    assert {(r.estate, r.label, r.n, r.hops) for r in ask["e06"](g, "T").collect()} == {("one", "SqlStatement", 2, 1), ("two", "SqlStatement", 1, 1)}
    assert {(r.estate, r.n) for r in ask["e10"](g).collect()} == {("one", 1), ("two", 1)}
    assert [(r.key, list(r.estates), r.n) for r in ask["e11"](g).collect()] == [("sql:1", ["one", "two"], 2)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish", "a"), (2, "one fish", "red"), (3, "", None)], "doc long, body string, name string")
    idx = search.index(docs, {"body": 1.0, "name": 3.0})
    assert [r.doc for r in search.bm25(idx, search.query_terms(spark, "red"), 5).collect()] == [2, 1]
    terms = {r.term: r.weight for r in search.query_terms(spark, "red fishTank", {"red": ["scarlet"]}).collect()}
    assert terms == {"red": 1.0, "fish": 1.0, "tank": 1.0, "scarlet": 0.45}
    lists = [spark.createDataFrame([(1, 3.0), (2, 2.0)], "doc long, score double"), spark.createDataFrame([(2, 9.0), (4, 1.0)], "doc long, score double")]
    assert [r.doc for r in search.fuse(lists, 3).collect()] == [2, 1, 4]


def test_content_hash_dedupe(spark, tmp_path):
    texts = ["Plain  text", " plain\tTEXT ", "Größe é", "größe  É", "Größe\né", "漢字", "漢字", None, "", " \n", "once", "É"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = {}
    for k, t in enumerate(texts):
        spaced = re.sub("[ \t\n\r]+", " ", t or "").strip(" ")
        plain.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in spaced), []).append(k)
    want = {("sql:" + hashlib.sha1(t.encode()).hexdigest()[:16], len(k), min(k)) for t, k in plain.items() if len(k) > 1}
    assert {tuple(r) for r in text.content_hash_dedupe(spark, str(tmp_path)).collect()} == want and {(n, k) for _, n, k in want} == {(2, 0), (2, 2), (2, 5), (3, 7)}


@pytest.fixture(scope="module")
def small(spark):
    """A graph with something of every label and type that the questions ask for."""
    n = [
        ("p1", "Process", "P1", {}), ("p2", "Process", "P2", {}), ("a1", "Activity", "A1", {"category": "DATABASE", "type": "jdbc", "starter": "True", "statement": "select * from t"}), ("r1", "SharedResource", "R1", {"type": "sharedjdbc", "url": "localhost", "embeddedCredential": "true"}),
        ("v1", "GlobalVariable", "Db/Password", {"value": "***MASKED***"}), ("x1", "ExternalReference", "X1", {}), ("g1", "Page", "G1", {"id": "5", "pageIsPublicYN": "Y"}), ("g2", "Page", "G2", {"id": "6"}), ("i1", "PageItem", "I1_TOKEN", {"isPrimaryKey": "Y"}), ("q1", "Region", "Q1", {"plugSource": "hi &NAME. and &APP_ID."}),
        ("s1", "SqlStatement", "select * from t", {"selectStar": "true", "verb": "SELECT", "text": "select * from t", "joinCount": "5", "bindCount": "0", "estate": "one"}), ("two/s1", "SqlStatement", "select * from t", {"estate": "two", "verb": "UPDATE"}), ("b1", "PlsqlBlock", "begin", {"commits": "true", "othersNull": "true", "dynamicSql": "true", "concatenatesInput": "true"}),
        ("u1", "DbProgramUnit", "U1", {"dynamicSql": "true", "commits": "true", "complexity": "4"}), ("u2", "DbProgramUnit", "U2", {"package": "K"}), ("k1", "DbPackage", "K", {}), ("t1", "DbTable", "T1", {"numRows": "900000", "estates": "one;two"}), ("w1", "DbView", "W1", {"status": "INVALID"}), ("m1", "DbTrigger", "M1", {"commits": "true"}),
        ("z1", "UnresolvedReference", "Z1", {"kinds": "table"}), ("o1", "Issue", "bad", {"rule": "X-001", "severity": "HIGH", "category": "data", "estate": "one"}), ("d1", "Recommendation", "do", {}), ("e1", "Schema", "E1", {}), ("f1", "SchemaElement", "F1", {}), ("c1", "DbColumn", "C1", {}), ("l1", "Lov", "L1", {}), ("h1", "Authorization", "H1", {}), ("n1", "Button", "N1", {"buttonAction": "SUBMIT"}), ("y1", "BusinessFunction", "Y1", {}),
    ]
    e = [
        ("p1", "a1", "CONTAINS_ACTIVITY"), ("p1", "p2", "INVOKES"), ("p2", "p1", "INVOKES"), ("a1", "r1", "CONFIGURED_BY"), ("p2", "x1", "INVOKES"), ("a1", "v1", "USES_VARIABLE"), ("g1", "q1", "CONTAINS_REGION"), ("g1", "i1", "CONTAINS_ITEM"), ("q1", "s1", "EXECUTES_SQL"), ("g2", "b1", "EXECUTES_PLSQL"), ("b1", "t1", "WRITES_TO"),
        ("s1", "t1", "READS_FROM"), ("u1", "s1", "EXECUTES_SQL"), ("u1", "two/s1", "EXECUTES_SQL"), ("two/s1", "t1", "WRITES_TO"), ("u2", "u1", "CALLS"), ("k1", "u2", "DECLARES"), ("w1", "t1", "DEPENDS_ON"), ("m1", "t1", "FIRES_ON"), ("u1", "z1", "UNRESOLVED"), ("o1", "d1", "HAS_RECOMMENDATION"), ("e1", "f1", "DEFINES"), ("t1", "c1", "HAS_COLUMN"), ("s1", "c1", "REFERENCES_COLUMN"),
        ("g1", "g2", "NAVIGATES_TO"), ("y1", "u1", "IMPLEMENTED_BY"), ("commit:1", "u1", "CHANGES"), ("a1", "t1", "WRITES_TO"),
    ]
    return Graph(
        spark.createDataFrame([(*r, k) for k, r in enumerate(n)], NODES).coalesce(1),
        spark.createDataFrame([(*r, {"basis": "name", "origin": "inferred", "confidence": "0.6"} if r[0] == "a1" else {}, k) for k, r in enumerate(e)], EDGES).coalesce(1),
    )


ARGS = {"a03": ("T1",), "a04": ("T1",), "a05": ("C1",), "a12": (["commit:1"],), "a16": ("G1",), "o03": ("T1",), "o05": ("T1",), "e06": ("T1",)}


def test_cookbook(small):
    assert len(COOKBOOK) == 67
    got = {f.__name__[:3]: f(small, *ARGS.get(f.__name__[:3], ())).collect() for f in COOKBOOK.values()}
    assert {r.label: r.n for r in got["t01"]}["Page"] == 2
    assert len(got["t08"]) == 1 and [r.name for r in got["o10"]] == ["W1"] and {r.unit for r in got["o03"]} == {"U1"} and {r.name for r in got["o05"]} == {"Q1", "U1", "U2"}
    assert got["a04"][0].owner in ("g1", "g2") and {r.table for r in got["o18"]} == {"T1"} and len(got["e02"]) == 1 and len(got["e11"]) == 1


def test_catalogue(small):
    found = {r.rule for c in ALL.values() for r in rules.issues(small, c()).collect()}
    assert {"T-SEC-001", "T-SEC-002", "T-SEC-003", "T-CORR-001", "T-PERF-001", "T-DEBT-003", "O-SEC-001", "O-CORR-002", "O-CORR-003", "O-PERF-003", "O-DEBT-003", "A-SEC-001", "A-SEC-002", "A-SEC-004", "A-SEC-007", "A-PERF-001", "A-PERF-004", "A-CORR-003", "X-003", "X-004", "X-007"} <= found
    assert "T-DEBT-001" not in found


def test_validation(small):
    report, status = validate.report(small, {"ids": validate.bad_ids, "ends": validate.dangling, "broken": lambda g: g.nodes.select("nothing"), "provenance": validate.provenance})
    assert status.first().status == "FAIL" and {r.rule for r in report.collect()} == {"REFERENTIAL_INTEGRITY", "RULE_ERROR"}


def test_refresh(spark, tmp_path):
    from quarrygraph.sources.integration import facts
    from quarrygraph.streaming.refresh import refresh

    schema = "path string, kind string, text string"
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([("m/a.process", "process5", "<p><name>a</name></p>"), ("m/b.process", "process5", "<p><name>b</name></p>")])
    refresh(spark.readStream.schema(schema).parquet(src), facts, out, mark).awaitTermination()
    write([("m/b.process", "process5", "<p><name>c</name></p>")])
    refresh(spark.readStream.schema(schema).parquet(src), facts, out, mark).awaitTermination()
    assert {r.name for r in spark.read.parquet(out).filter(F.col("kind") == "process").collect()} == {"a", "c"}
