"""The cookbook: questions to ask of any graph of an estate, each a function of a Graph (and, for some, a name).

T asks of integration graphs, A of applications, O of databases, E of federated graphs. Depths are bounded as
given; lists are sorted sets; rankings end in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import inventory as inv
from ..operators import traverse as tr

COOKBOOK: dict[str, object] = {}
_WRITES = ["WRITES_TO"]
_ACCESS = ["READS_FROM", "WRITES_TO", "INSERTS_INTO", "UPDATES", "DELETES_FROM"]


def entry(f):
    name = f.__name__
    COOKBOOK[f"Q-{name[0].upper()}-{name[1:3]} {name[4:].replace('_', '-')}"] = f
    return f


def p(key: str) -> Column:
    return F.col("props")[key]


def _ends(g: Graph, types: list[str], a: str, b: str) -> DataFrame:
    """Edges of some types with the names and labels of both ends, as a, a_label, b, b_label."""
    n = g.nodes.select("id", "label", "name")
    s = n.select(F.col("id").alias("src"), F.col("name").alias(a), F.col("label").alias(a + "_label"))
    d = n.select(F.col("id").alias("dst"), F.col("name").alias(b), F.col("label").alias(b + "_label"))
    return g.of_type(*types).join(s, "src").join(d, "dst")


def _reach(g: Graph, label: str, types: list[str], depth: int, goal: str | None = None, reverse: bool = False) -> DataFrame:
    """Pairs of a node of a label and what it reaches, with least hops."""
    r = tr.min_hops(g.of_type(*types), g.by_label(label).select("id"), depth, reverse).filter("hops > 0")
    n = g.nodes.select("id", F.col("name").alias("reached"), F.col("label").alias("reached_label"))
    r = r.join(n.filter(F.col("reached_label") == goal) if goal else n, "id")
    return r.join(g.nodes.select(F.col("id").alias("root"), "name"), "root").select("name", "reached", "reached_label", "hops")


def _named(g: Graph, name: str) -> DataFrame:
    return g.nodes.filter(F.col("name") == name).select("id")


def _counts(g: Graph) -> DataFrame:
    return inv.label_counts(g).orderBy(F.desc("n"), "label")


def _types(g: Graph) -> DataFrame:
    return inv.type_counts(g).orderBy(F.desc("n"), "type")


def _severity(c: str = "severity") -> Column:
    return F.when(F.col(c) == "CRITICAL", 0).when(F.col(c) == "HIGH", 1).when(F.col(c) == "MEDIUM", 2).otherwise(3)


def _issues(g: Graph) -> DataFrame:
    i = g.by_label("Issue").select("id", p("rule").alias("rule"), p("severity").alias("severity"), p("category").alias("category"), p("estate").alias("estate"), F.col("name").alias("message"))
    a = _ends(g, ["HAS_RECOMMENDATION"], "x", "advice").select(F.col("src").alias("id"), "advice")
    return i.join(a, "id", "left").orderBy(_severity(), "rule", "id")


# --- integration ---


@entry
def t01_node_counts(g):
    return _counts(g)


@entry
def t02_rel_counts(g):
    return _types(g)


@entry
def t03_entry_points(g):
    return _ends(g, ["CONTAINS_ACTIVITY"], "process", "activity").join(g.by_label("Activity").filter(p("starter") == "True").select(F.col("id").alias("dst"), p("type").alias("trigger")), "dst").select("process", "activity", "trigger").orderBy("process", "activity")


@entry
def t04_complexity_ranking(g):
    return inv.edge_profile(g, "Process", {"CONTAINS_ACTIVITY": "activities", "INVOKES": "calls", "HANDLES_ERROR": "handlers"}, 40)


@entry
def t05_schema_blast_radius(g):
    return _reach(g, "Schema", ["USES_XSD", "IMPORTS"], 3, reverse=True)


@entry
def t06_field_blast_radius(g):
    return _ends(g, ["DEFINES"], "schema", "field").join(_ends(g, ["USES_XSD"], "user", "used").select("user", F.col("dst").alias("src")), "src").select("schema", "field", "user").distinct()


@entry
def t07_reachable_entry_points(g):
    r = _reach(g, "Process", ["INVOKES"], 8, "Process", reverse=True)
    return r.join(t03_entry_points(g).select(F.col("process").alias("reached")).distinct(), "reached")


@entry
def t08_circular_dependencies(g):
    return tr.paths(g.of_type("INVOKES"), 2, 10, closed=True).limit(50)


@entry
def t09_orphan_schemas(g):
    return inv.unreferenced(g, "Schema", ["USES_XSD", "IMPORTS"]).select("id", "name")


@entry
def t10_unreachable_processes(g):
    return inv.unreferenced(g, "Process", ["INVOKES"]).join(t03_entry_points(g).select(F.col("process").alias("name")), "name", "left_anti").select("id", "name")


@entry
def t11_shared_hotspots(g):
    return inv.hotspots(g, excluded=["CONTAINS", "CONTAINS_ACTIVITY", "TRANSITIONS_TO"])


@entry
def t12_external_systems(g):
    return g.by_label("ExternalReference", "SharedResource").join(_ends(g, ["INVOKES", "CONFIGURED_BY"], "user", "used").select(F.col("dst").alias("id"), "user"), "id", "left").groupBy("id", "label", "name").agg(inv.names("user").alias("users"))


@entry
def t13_error_coverage(g):
    return inv.unreferenced(g, "Process", ["HANDLES_ERROR"], incoming=False).join(g.of_type("CONTAINS_ACTIVITY").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("activities")).filter("activities > 3"), "id").select("name", "activities")


@entry
def t14_global_variable_usage(g):
    return g.by_label("GlobalVariable").join(g.of_type("USES_VARIABLE").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("uses")), "id", "left").select("name", F.coalesce("uses", F.lit(0)).alias("uses")).orderBy(F.desc("uses"), "name")


@entry
def t15_activity_mix(g):
    return g.by_label("Activity").groupBy(p("category").alias("category"), p("type").alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


# --- application ---

_DOWN = ["CONTAINS", "CONTAINS_REGION", "CONTAINS_ITEM", "CONTAINS_PROCESS", "EXECUTES_SQL", "EXECUTES_PLSQL", "CALLS", *_ACCESS, "USES_LOV", "TRIGGERS"]


@entry
def a01_node_counts(g):
    return _counts(g)


@entry
def a02_rel_counts(g):
    return _types(g)


@entry
def a03_impact_procedure(g, name: str):
    r = tr.min_hops(g.of_type(*_DOWN), _named(g, name), 8, reverse=True).filter("hops > 0")
    return r.join(g.nodes, "id").groupBy("label", "name").agg(F.min("hops").alias("hops")).orderBy("hops", "label", "name")


@entry
def a04_impact_table(g, name: str):
    direct = _ends(g, _ACCESS, "user", "table").filter(F.col("table") == name).select(F.col("src").alias("id"), F.col("type").alias("mode"))
    pages = tr.owner(g, direct.select("id").distinct(), _DOWN, "Page")
    return direct.join(pages, "id").groupBy("owner").agg(inv.names("mode").alias("modes"), inv.names("id").alias("components"))


@entry
def a05_column_lineage(g, name: str):
    return tr.min_hops(g.of_type(*_DOWN, "REFERENCES_COLUMN"), _named(g, name), 6, reverse=True).filter("hops > 0").join(g.nodes, "id").select("label", "name", "hops")


@entry
def a06_orphan_units(g):
    used = tr.min_hops(g.of_type(*_DOWN), g.by_label("Page", "Application").select("id"), 8).select("id").distinct()
    return inv.unreferenced(g, "UnitReference", ["CALLS"]).join(used, "id", "left_anti").select("id", "name")


@entry
def a07_unreachable_pages(g):
    return inv.unreferenced(g, "Page", ["NAVIGATES_TO"]).filter(~F.coalesce(p("id"), F.lit("")).isin("0", "1", "101")).select("id", "name")


@entry
def a08_complexity_ranking(g):
    reached = tr.min_hops(g.of_type(*_DOWN), g.by_label("Page").select("id"), 8)
    return reached.filter("hops > 0").groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("reached"), F.max("hops").alias("depth")).orderBy(F.desc("reached"), "id").limit(25)


@entry
def a09_unsecured_writes(g):
    open_ = inv.unreferenced(g, "Page", ["SECURED_BY"], incoming=False)
    r = tr.min_hops(g.of_type(*_DOWN), open_.select("id"), 8).select("root", F.col("id").alias("src"))
    return r.join(_ends(g, _WRITES, "x", "table").select("src", "table"), "src").groupBy(F.col("root").alias("page")).agg(inv.names("table").alias("tables"))


@entry
def a10_duplicate_sql(g):
    return _ends(g, ["EXECUTES_SQL"], "component", "sql").groupBy(F.col("dst").alias("id"), "sql").agg(F.count(F.lit(1)).alias("n"), F.slice(inv.names("component"), 1, 5).alias("sample")).filter("n >= 3").orderBy(F.desc("n"), "id")


@entry
def a11_issues_by_severity(g):
    return _issues(g)


@entry
def a12_release_impact(g, commits: list[str]):
    files = g.of_type("CHANGES").filter(F.col("src").isin(*commits)).select(F.col("dst").alias("id"))
    return tr.min_hops(g.of_type("DEFINED_IN", *_DOWN), files, 6, reverse=True).filter("hops > 0").join(g.nodes, "id").groupBy("label").agg(F.count_distinct("id").alias("n"), F.min("hops").alias("hops"))


@entry
def a13_business_traceability(g):
    return _reach(g, "BusinessFunction", ["IMPLEMENTED_BY", *_DOWN], 8).groupBy("name").agg(inv.names("reached").alias("reached"))


@entry
def a14_provenance_audit(g):
    return g.edges.groupBy(F.coalesce(p("resolution"), F.lit("declared")).alias("resolution")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(p("confidence").cast("double"), F.lit(1.0))), 3).alias("confidence"))


@entry
def a15_unresolved_references(g):
    return _ends(g, ["UNRESOLVED"], "user", "reference").groupBy("reference").agg(F.count(F.lit(1)).alias("n"), F.slice(inv.names("user"), 1, 5).alias("sample")).orderBy(F.desc("n"), "reference")


@entry
def a16_page_dependency_tree(g, name: str):
    return tr.min_hops(g.of_type(*_DOWN), _named(g, name), 7).filter("hops > 0").join(g.nodes, "id").select("label", "name", "hops").orderBy("hops", "label", "name")


@entry
def a17_table_hotspots(g):
    return inv.hotspots(g, _ACCESS)


# --- database ---


@entry
def o01_node_counts(g):
    return _counts(g)


@entry
def o02_rel_counts(g):
    return _types(g)


def _executed(g: Graph, types: list[str]) -> DataFrame:
    """unit, table and type of access by the statements that units execute."""
    s = _ends(g, types, "statement", "table").select(F.col("src").alias("sid"), "table", "table_label", "type")
    return _ends(g, ["EXECUTES_SQL"], "unit", "x").select(F.col("src").alias("unit_id"), "unit", F.col("dst").alias("sid")).join(s, "sid")


@entry
def o03_writers_of_table(g, name: str):
    return _executed(g, _WRITES).filter(F.col("table") == name).select("unit").distinct()


@entry
def o04_access_verbs(g):
    return _executed(g, _ACCESS).groupBy("table", "type").agg(F.count(F.lit(1)).alias("n"))


@entry
def o05_blast_radius(g, name: str):
    direct = _executed(g, _ACCESS).filter(F.col("table") == name).select(F.col("unit_id").alias("id")).distinct()
    return tr.min_hops(g.of_type("CALLS"), direct, 6, reverse=True).groupBy("id").agg(F.min("hops").alias("hops")).join(g.nodes.select("id", "name"), "id")


@entry
def o06_call_graph(g):
    return tr.paths(g.of_type("CALLS"), 1, 10).limit(100)


@entry
def o07_entry_points(g):
    lone = inv.unreferenced(g, "DbProgramUnit", ["CALLS"]).select("name", F.lit("uncalled").alias("why"))
    trig = g.by_label("DbTrigger").select("name", F.lit("trigger").alias("why"))
    return lone.unionByName(trig).unionByName(g.by_label("DbProgramUnit").filter(p("package").isNull()).select("name", F.lit("standalone").alias("why"))).distinct()


@entry
def o08_spec_change_impact(g):
    d = _ends(g, ["DECLARES"], "package", "unit").select("package", "unit", F.col("dst").alias("id"))
    return d.join(_ends(g, ["CALLS"], "caller", "called").select(F.col("dst").alias("id"), "caller"), "id", "left").groupBy("package").agg(inv.names("unit").alias("units"), inv.names("caller").alias("callers"))


@entry
def o09_hotspots(g):
    return inv.hotspots(g, excluded=["CONTAINS", "DECLARES", "HAS_COLUMN"])


@entry
def o10_view_lineage(g):
    return _reach(g, "DbView", ["DEPENDS_ON"], 5)


@entry
def o11_table_lineage(g):
    e = _executed(g, _ACCESS)
    return e.groupBy("table").agg(inv.names(F.when(F.col("type") == "READS_FROM", F.col("unit"))).alias("readers"), inv.names(F.when(F.col("type") == "WRITES_TO", F.col("unit"))).alias("writers"))


@entry
def o12_column_usage(g):
    c = _ends(g, ["HAS_COLUMN"], "table", "column").select("table", "column", F.col("dst").alias("id"))
    return c.join(g.of_type("REFERENCES_COLUMN").select(F.col("dst").alias("id"), "src"), "id", "left").groupBy("table", "column").agg(inv.names("src").alias("statements"))


@entry
def o13_join_partners(g):
    return inv.partners(_ends(g, ["READS_FROM"], "s", "table").select("src", "table"), "src", "table")


@entry
def o14_type_dependents(g):
    return _ends(g, ["USES_TYPE"], "user", "type_name").groupBy("type_name").agg(inv.names("user").alias("users"))


@entry
def o15_business_to_data(g):
    return _ends(g, ["IMPLEMENTED_BY"], "business", "unit").select("business", F.col("dst").alias("unit_id")).join(_executed(g, _ACCESS), "unit_id").groupBy("business").agg(inv.names("table").alias("tables"))


@entry
def o16_untested_entry_points(g):
    called = g.of_type("HAS_TEST").select(F.col("src").alias("id"))
    return inv.unreferenced(g, "DbProgramUnit", ["CALLS"]).join(called, "id", "left_anti").select("id", "name")


@entry
def o17_test_coverage(g):
    return _ends(g, ["HAS_TEST"], "unit", "test").groupBy("unit").agg(inv.names("test").alias("tests"))


@entry
def o18_trigger_map(g):
    return _ends(g, ["FIRES_ON"], "trigger", "table").select("trigger", "table")


@entry
def o19_dynamic_sql(g):
    return g.by_label("DbProgramUnit").filter(p("dynamicSql") == "true").select("id", "name")


@entry
def o20_unresolved(g):
    return g.by_label("UnresolvedReference").groupBy(p("kinds").alias("kinds")).agg(F.count(F.lit(1)).alias("n"), inv.names("name").alias("references"))


@entry
def o21_findings(g):
    return _issues(g)


@entry
def o22_dead_code(g):
    fired = g.of_type("FIRES_ON").select(F.col("src").alias("id"))
    return inv.unreferenced(g, "DbProgramUnit", ["CALLS", "IMPLEMENTED_BY"]).join(fired, "id", "left_anti").select("id", "name")


@entry
def o23_churn_vs_complexity(g):
    return inv.churn(g.of_type("CHANGES").select(F.col("dst").alias("id")), g.by_label("DbProgramUnit").select("id", p("complexity").cast("double").alias("value")))


# --- federated ---


def _estates(c: str = "estates") -> Column:
    return F.split(p(c), ";")


@entry
def e01_node_counts_by_estate(g):
    return g.nodes.groupBy(p("estate").alias("estate"), "label").agg(F.count(F.lit(1)).alias("n"))


@entry
def e02_shared_database_objects(g):
    return g.nodes.filter(F.size(_estates()) > 1).select("id", "label", "name", p("estates").alias("estates"))


@entry
def e03_contended_tables(g):
    w = g.of_type(*_WRITES).join(g.nodes.select(F.col("id").alias("src"), p("estate").alias("estate")), "src")
    return w.groupBy(F.col("dst").alias("table")).agg(inv.names("estate").alias("writers")).filter(F.size("writers") > 1)


def _crossing(g: Graph, types: list[str]) -> DataFrame:
    return g.of_type(*types).filter(p("basis").isNotNull())


@entry
def e04_integration_to_table(g):
    owner = _ends(g, ["CONTAINS_ACTIVITY"], "process", "activity").select("process", "activity", F.col("dst").alias("src"))
    return owner.join(_crossing(g, _ACCESS).select("src", "dst", "type"), "src").select("process", "activity", F.col("dst").alias("table"), "type")


@entry
def e05_end_to_end_path(g):
    up = _reach(g, "Process", ["CONTAINS_ACTIVITY", "INVOKES", *_ACCESS], 4, "DbTable")
    other = _ends(g, _ACCESS, "user", "reached").select("reached", "user").distinct()
    return up.join(other, "reached").select("name", "reached", "user", "hops")


@entry
def e06_blast_radius_across_estates(g, name: str):
    r = tr.min_hops(g.edges, _named(g, name), 4, reverse=True).filter("hops > 0").join(g.nodes, "id")
    return r.groupBy(p("estate").alias("estate"), "label").agg(F.count_distinct("id").alias("n"), F.min("hops").alias("hops"))


@entry
def e07_inferred_edges(g):
    return g.edges.filter(p("origin") == "inferred").select("src", "type", "dst", p("basis").alias("basis"), p("confidence").cast("double").alias("confidence")).orderBy("confidence", "src", "dst")


@entry
def e08_unmapped_datasources(g):
    return inv.unreferenced(g, "SharedResource", ["CONNECTS_TO_SCHEMA"], incoming=False).filter(F.lower(p("type")).contains("jdbc")).select("id", "name")


@entry
def e09_cross_estate_findings(g):
    return _issues(g).filter(F.col("rule").startswith("X-"))


@entry
def e10_findings_by_estate(g):
    return _issues(g).groupBy("estate", "severity", "category").agg(F.count(F.lit(1)).alias("n"))


@entry
def e11_duplicate_statements(g):
    n = g.by_label("SqlStatement").withColumn("key", F.element_at(F.split("id", "/"), -1))
    return n.groupBy("key").agg(inv.names(p("estate")).alias("estates"), F.count(F.lit(1)).alias("n")).filter(F.size("estates") > 1)


@entry
def e12_estate_coverage(g):
    return _ends(g, ["CONTAINS_ESTATE"], "root", "estate").groupBy("root").agg(inv.names("estate").alias("estates"))
