"""What the graph operators move, and that it changes nothing in what they give."""

import random

import pytest
from pyspark.sql import functions as F

from quarrygraph.model import EDGES, NODES, Graph
from quarrygraph.operators import rules, traverse, validate
from quarrygraph.operators.shared import Rounds

CHAIN = [("order:1", "customer:1"), ("order:2", "customer:1"), ("customer:1", "nation:1"), ("nation:1", "region:1"), ("order:2", "region:1")]


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are held."""
    seen, hold, keep = [], Rounds.hold, Rounds.keep
    note = lambda f: lambda self, df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), f(self, df))[1]
    monkeypatch.setattr(Rounds, "hold", note(hold))
    monkeypatch.setattr(Rounds, "keep", note(keep))
    return seen


def graph(spark, edges, nodes=None):
    nodes = sorted({x for e in edges for x in e[:2]}) if nodes is None else nodes
    return Graph(
        spark.createDataFrame([(n, "X", n, {}, i) for i, n in enumerate(nodes)], NODES).coalesce(1),
        spark.createDataFrame([(e[0], e[1], e[2] if len(e) > 2 else "T", {}, i) for i, e in enumerate(edges)], EDGES).coalesce(1),
    )


def plain_hops(edges, roots, depth):
    out = {}
    for r in roots:
        out[r, r], at = 0, {r}
        for hop in range(1, depth + 1):
            at = {d for s, d in edges if s in at and (r, d) not in out}
            out |= {(r, d): hop for d in at}
    return out


def random_edges(seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(("a:", "b:", "", "c:d:")) + str(rng.randrange(40))
    return [(name(), name()) for _ in range(170)]


@pytest.mark.parametrize("few", [True, False])
def test_hops_of_any_kinds(spark, few):
    edges = random_edges(few)
    roots = sorted({x for e in edges for x in e})[: 5 if few else 90]
    assert few or len(roots) > traverse.FEW
    e = graph(spark, edges + edges[:30]).edges
    got = traverse.min_hops(e, spark.createDataFrame([(r,) for r in roots], "id string"), 3).collect()
    assert len(got) == len({(r.root, r.id) for r in got}) and {(r.root, r.id): r.hops for r in got} == plain_hops(edges, roots, 3)


@pytest.mark.parametrize("few", [True, False])
def test_hops_compare_only_equal_kinds(spark, plans, few, monkeypatch):
    if not few:
        monkeypatch.setattr(traverse, "FEW", 1)
    roots = spark.createDataFrame([("order:1",), ("order:2",)], "id string")
    got = {(r.root, r.id): r.hops for r in traverse.min_hops(graph(spark, CHAIN).edges, roots, 8).collect()}
    assert got == plain_hops(CHAIN, ["order:1", "order:2"], 8)
    # only region:1 comes again; customers and nations are compared with nothing
    assert sum(("LeftAnti" if not few else "LeftOuter") in p for p in plans) == 1


def test_blast_radius_expands_a_node_once(spark, plans):
    got = {(r.id, round(r.weight, 6), r.hops, r.parent) for r in traverse.blast_radius(graph(spark, CHAIN), ["region:1"], "up", 8, {"T": 0.8}).collect()}
    assert got == {("region:1", 1.0, 0, None), ("nation:1", 0.6, 1, "region:1"), ("order:2", 0.6, 1, "region:1"), ("customer:1", 0.36, 2, "nation:1"), ("order:1", 0.216, 3, "customer:1")}
    # one table for each round that has steps, which are read but for the last, from orders, that no step leaves
    assert len(plans) == 3


def counting(spark):
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        n.add(1)
        return x

    return n, counted


def test_checks_run_once(spark):
    g, (n, counted) = graph(spark, CHAIN), counting(spark)
    report, status = validate.report(g, {"all": lambda g: validate.finding(g.nodes, "INFO", "ANY", counted(F.col("id")))})
    assert [(r.n, len(r.details)) for r in report.collect()] == [(5, 5)] and status.first().status == "PASS" and n.value == 5


def test_odd_ids(spark):
    g = graph(spark, [("a", "b"), ("a", "b"), ("a", "x"), ("y", "b"), (None, "a")], ["a", "b", "b", "c", "c", "d", None])
    rows = lambda df: sorted((r.rule, r.detail or "") for r in df.collect())
    assert rows(validate.bad_ids(g)) == [("DUPLICATE_ID", "b"), ("DUPLICATE_ID", "c"), ("NODE_ID", "")]
    assert rows(validate.dangling(g)) == [("REFERENTIAL_INTEGRITY", d) for d in ("T a", "a T x", "y T b")]
    assert rows(validate.orphans(g)) == [("ORPHAN", d) for d in ("", "c", "c", "d")] and rows(validate.orphans(g, {"X"})) == []


def test_sound_graph_moves_no_edge(spark):
    g = graph(spark, CHAIN)
    assert "Join" not in validate.dangling(g)._jdf.queryExecution().optimizedPlan().toString() and validate.dangling(g).isEmpty()


def test_ledger_finds_once(spark):
    g, (n, counted) = graph(spark, CHAIN), counting(spark)
    rule = rules.Rule("R", "LOW", "debt", "", "Do.", lambda g: g.nodes.select(counted(F.col("id")).alias("target"), F.col("name").alias("message")))
    made = rules.ledger(rules.issues(g, [rule]))
    assert (made.nodes.count(), made.edges.count()) == (6, 15) and made.nodes.filter("label = 'Issue' and name = 'order:1'").count() == 1 and n.value == 5


def test_at_least_moves_pairs_before_it_tells_them_apart(spark):
    edges = [(f"o{i % 20}", "s1", "AB"[i % 2]) for i in range(60)] + [(f"o{i}", "s2", "A") for i in range(9)] + [(None, "s2", "A")]
    found = rules.at_least("X", ["A", "B"], 10)(graph(spark, edges, ["s1", "s2"]))
    assert [tuple(r) for r in found.collect()] == [("s1", "s1 20")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan and "count(distinct" not in plan
