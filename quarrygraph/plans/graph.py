"""Graph queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import gates, inventory, merge, resolve, rules, traverse, validate
from ..sources.supply import WEIGHTS, supply_graph, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Edges of the supply graph in SQL.
_EDGES = """e AS (
 SELECT 'nation:'||n_nationkey AS src, 'region:'||n_regionkey AS dst, 'PART_OF' AS type FROM nation
 UNION ALL SELECT 'customer:'||c_custkey, 'nation:'||c_nationkey, 'LOCATED_IN' FROM customer
 UNION ALL SELECT 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'LOCATED_IN' FROM supplier
 UNION ALL SELECT 'order:'||o_orderkey, 'customer:'||o_custkey, 'PLACED_BY' FROM orders
 UNION ALL SELECT DISTINCT 'order:'||l_orderkey, 'supplier:'||l_suppkey, 'SUPPLIED_BY' FROM lineitem
 UNION ALL SELECT DISTINCT 'part:'||l_partkey, 'supplier:'||l_suppkey, 'SUPPLIED_BY' FROM lineitem
 UNION ALL SELECT DISTINCT 'order:'||l_orderkey, 'part:'||l_partkey, 'CONTAINS' FROM lineitem)"""
_NODES = """v AS (
 SELECT 'region:'||r_regionkey AS id, 'region' AS label, r_name AS name FROM region UNION ALL SELECT 'nation:'||n_nationkey, 'nation', n_name FROM nation
 UNION ALL SELECT 'customer:'||c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'supplier:'||s_suppkey, 'supplier', s_name FROM supplier
 UNION ALL SELECT 'part:'||p_partkey, 'part', p_name FROM part UNION ALL SELECT 'order:'||o_orderkey, 'order', o_orderpriority FROM orders)"""
_W = "CASE type WHEN 'PART_OF' THEN 0.9 WHEN 'LOCATED_IN' THEN 0.8 WHEN 'PLACED_BY' THEN 1.0 WHEN 'SUPPLIED_BY' THEN 0.7 ELSE 0.4 END"
_REACH = f"""WITH RECURSIVE {_EDGES}, r AS (
 SELECT 'region:0' AS id, 1.0::DOUBLE AS weight, 0 AS hops
 UNION ALL SELECT DISTINCT e.src, r.weight * ({_W})::DOUBLE * 0.75::DOUBLE, r.hops + 1 FROM r JOIN e ON e.dst = r.id
 WHERE r.weight * ({_W})::DOUBLE * 0.75 >= 0.01),
b AS (SELECT id, max(weight) AS weight, arg_max(hops, weight) AS hops FROM r GROUP BY id)"""


@query(f"WITH {_NODES} SELECT label, count(*) AS n FROM v GROUP BY label")
def graph_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.label_counts(supply_graph(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT type, count(*) AS n FROM e GROUP BY type")
def graph_type_counts(spark, sf_dir):
    return inventory.type_counts(supply_graph(spark, sf_dir))


@query(f"{_REACH} SELECT id, split_part(id, ':', 1) AS label, CAST(hops AS INTEGER) AS hops, round(weight, 4) AS weight FROM b WHERE hops > 0")
def blast_radius_region(spark, sf_dir):
    g = supply_graph(spark, sf_dir, parallel=True)
    return traverse.impact_rows(g, traverse.blast_radius(g, ["region:0"], "up", 8, WEIGHTS), ranked=False).select("id", "label", "hops", "weight")


@query(f"""{_REACH}, s AS (SELECT count(*) AS affected, count(*) FILTER (WHERE id LIKE 'order:%') AS entry_points,
 sum(weight * CASE WHEN id LIKE 'nation:%' THEN 2.0 ELSE 1.0 END) + 6 * count(*) FILTER (WHERE id LIKE 'order:%') AS x FROM b WHERE hops > 0)
SELECT affected, entry_points, round(x, 2) AS score, CASE WHEN x > 60 THEN 'CRITICAL' WHEN x > 30 THEN 'HIGH' WHEN x > 12 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM s""")
def blast_radius_summary(spark, sf_dir):
    g = supply_graph(spark, sf_dir, parallel=True)
    return traverse.risk_summary(g, traverse.blast_radius(g, ["region:0"], "up", 8, WEIGHTS), {"nation": 2.0}, F.col("label") == "order")


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT src AS root, src AS id, 0 AS hops FROM e WHERE src LIKE 'order:%'
 UNION SELECT r.root, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.id WHERE e.type IN ('PLACED_BY', 'LOCATED_IN', 'PART_OF', 'SUPPLIED_BY'))
SELECT root, id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY root, id""")
def descend_min_hops(spark, sf_dir):
    g = supply_graph(spark, sf_dir, parallel=True)
    return traverse.descend(g, g.by_label("order"), ["PLACED_BY", "LOCATED_IN", "PART_OF", "SUPPLIED_BY"])


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 'region:'||r_regionkey AS root, 'region:'||r_regionkey AS id, 0 AS hops FROM region
 UNION SELECT r.root, e.src, r.hops + 1 FROM r JOIN e ON e.dst = r.id)
SELECT root, id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY root, id""")
def ascend_min_hops(spark, sf_dir):
    g = supply_graph(spark, sf_dir, parallel=True)
    return traverse.ascend(g, g.by_label("region"), list(WEIGHTS))


@query("""SELECT 'order:'||o_orderkey AS id, 'region:'||n_regionkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def owning_ancestor(spark, sf_dir):
    g = supply_graph(spark, sf_dir, parallel=True)
    return traverse.owner(g, g.by_label("order"), ["PLACED_BY", "LOCATED_IN", "PART_OF"], "region", reverse=False)


@query(f"WITH {_EDGES} SELECT dst AS id, split_part(dst, ':', 1) AS label, count(*) AS dependents, string_agg(DISTINCT type, ',' ORDER BY type) AS kinds FROM e GROUP BY dst ORDER BY dependents DESC, id LIMIT 25")
def hotspots_top25(spark, sf_dir):
    return inventory.hotspots(supply_graph(spark, sf_dir)).select("id", "label", "dependents", F.array_join("kinds", ",").alias("kinds"))


@query("""SELECT 'customer:'||c_custkey AS id, 'customer' AS label FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'part:'||p_partkey, 'part' FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""")
def dead_nodes(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    dead = [inventory.unreferenced(g, label, [kind]).select("id", "label") for label, kind in (("customer", "PLACED_BY"), ("part", "CONTAINS"))]
    return dead[0].unionByName(dead[1])


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT array_to_string(m, ',') AS members, count(*) AS n FROM s WHERE len(m) >= 2 GROUP BY m""")
def join_partners(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return inventory.partners(pairs, "l_orderkey", "p_brand").select(F.array_join("members", ",").alias("members"), "n")


_ACCESS = """a AS (SELECT c_mktsegment AS segment, p_type AS kind, CASE l_returnflag WHEN 'R' THEN 'DELETE' WHEN 'A' THEN 'UPDATE' ELSE 'SELECT' END AS verb
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


@query(f"WITH {_ACCESS} SELECT segment, kind, string_agg(DISTINCT verb, ',' ORDER BY verb) AS verbs, bool_or(verb <> 'SELECT') AS write FROM a GROUP BY 1, 2")
def data_access_matrix(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    a = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    verb = F.when(F.col("l_returnflag") == "R", "DELETE").when(F.col("l_returnflag") == "A", "UPDATE").otherwise("SELECT")
    a = a.select(F.col("c_mktsegment").alias("segment"), F.col("p_type").alias("kind"), verb.alias("verb"))
    return inventory.access_matrix(a, "segment", "kind", "verb", ["DELETE", "UPDATE"]).withColumn("verbs", F.array_join("verbs", ","))


_REGIONAL = "SELECT DISTINCT l_partkey, l_returnflag, n_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def _regional(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("l_partkey").cast("string").alias("table"), F.col("n_regionkey").cast("string").alias("estate"), (F.col("l_returnflag") != "N").alias("write"))


@query("""SELECT CAST(l_partkey AS VARCHAR) AS "table", string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), ',' ORDER BY CAST(n_regionkey AS VARCHAR)) FILTER (WHERE l_returnflag <> 'N') AS writers,
 count(*) FILTER (WHERE l_returnflag <> 'N') AS n_writes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY l_partkey HAVING count(DISTINCT n_regionkey) FILTER (WHERE l_returnflag <> 'N') >= 2""")
def contended(spark, sf_dir):
    return inventory.contended(_regional(spark, sf_dir)).select("table", F.array_join("writers", ",").alias("writers"), "n_writes")


@query("""SELECT 'supplier:'||l_suppkey AS component, string_agg(DISTINCT CAST(cn.n_regionkey AS VARCHAR), ',' ORDER BY CAST(cn.n_regionkey AS VARCHAR)) AS reaches,
 string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS access, min(l_discount) AS confidence
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE sn.n_regionkey <> cn.n_regionkey GROUP BY l_suppkey""")
def boundary_components(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    own, other = t("nation").alias("sn"), t("nation").alias("cn")
    rows = (
        t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(own, F.col("s_nationkey") == F.col("sn.n_nationkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(other, F.col("c_nationkey") == F.col("cn.n_nationkey")).filter("sn.n_regionkey <> cn.n_regionkey")
    )
    links = rows.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("component"), F.col("cn.n_regionkey").cast("string").alias("target_estate"), F.col("l_returnflag").alias("access"), F.col("l_discount").alias("confidence"))
    return inventory.boundary(links).select("component", F.array_join("reaches", ",").alias("reaches"), F.array_join("access", ",").alias("access"), "confidence")


@query("""SELECT c_nationkey AS module, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, round(sum(c_acctbal), 1) AS balance FROM customer GROUP BY 1""")
def module_metrics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "module")
    return inventory.module_metrics(c, "module", {"in_debt": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING"}, {"balance": F.col("c_acctbal")})


@query("""SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS module, CAST(s_nationkey AS VARCHAR) AS depends_on FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey""")
def module_dependencies(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    edges = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    of = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("module")).unionByName(
        t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("module"))
    )
    return inventory.module_dependencies(edges, of)


@query("""SELECT 'customer:'||c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION SELECT 'customer:'||o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
UNION SELECT 'supplier:'||s_suppkey FROM supplier WHERE s_acctbal < 0""")
def entry_points_union(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    c = lambda label, k: F.concat(F.lit(label + ":"), F.col(k).cast("string")).alias("id")
    return (
        t("customer").filter("c_acctbal > 9000").select(c("customer", "c_custkey")).unionByName(t("orders").filter("o_orderpriority = '1-URGENT'").select(c("customer", "o_custkey")))
        .unionByName(t("supplier").filter("s_acctbal < 0").select(c("supplier", "s_suppkey"))).distinct()
    )


@query("""WITH s AS (SELECT l_orderkey, count(*) + 0.5 * count(DISTINCT l_partkey) + 3 * count(*) FILTER (WHERE l_returnflag = 'R') AS score FROM lineitem GROUP BY 1)
SELECT CASE WHEN score >= 20 THEN 'VERY_HIGH' WHEN score >= 12 THEN 'HIGH' WHEN score >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS n, CAST(max(score) AS DOUBLE) AS top FROM s GROUP BY 1""")
def complexity_tiers(spark, sf_dir):
    from ..functions.ids import tier

    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) + 0.5 * F.count_distinct("l_partkey") + 3 * F.count_if(F.col("l_returnflag") == "R")).cast("double").alias("score"))
    return s.groupBy(tier(F.col("score"), [("VERY_HIGH", 20), ("HIGH", 12), ("MEDIUM", 6), ("LOW", 0)]).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


RULES = [
    rules.Rule("S-DEBT-001", "LOW", "debt", "Customer without orders", "Archive it.", rules.without("customer", ["PLACED_BY"])),
    rules.Rule("S-DEBT-002", "MEDIUM", "debt", "Part never ordered", "Drop it.", rules.without("part", ["CONTAINS"])),
    rules.Rule("S-PERF-001", "HIGH", "performance", "Supplier of many orders", "Split it.", rules.at_least("supplier", ["SUPPLIED_BY"], 600)),
    rules.Rule("S-CORR-001", "MEDIUM", "correctness", "Urgent order", "Look at it.", rules.where("order", "name = '1-URGENT'")),
]
_ISSUES = f"""i AS (SELECT 'S-DEBT-001' AS rule, 'LOW' AS severity, 'debt' AS category, id AS target FROM v WHERE label = 'customer' AND id NOT IN (SELECT dst FROM e WHERE type = 'PLACED_BY')
 UNION ALL SELECT 'S-DEBT-002', 'MEDIUM', 'debt', id FROM v WHERE label = 'part' AND id NOT IN (SELECT dst FROM e WHERE type = 'CONTAINS')
 UNION ALL SELECT 'S-PERF-001', 'HIGH', 'performance', dst FROM e WHERE type = 'SUPPLIED_BY' GROUP BY dst HAVING count(DISTINCT src) >= 600
 UNION ALL SELECT 'S-CORR-001', 'MEDIUM', 'correctness', id FROM v WHERE label = 'order' AND name = '1-URGENT')"""


@query(f"WITH {_NODES}, {_EDGES}, {_ISSUES} SELECT rule, severity, category, target FROM i")
def rule_findings(spark, sf_dir):
    return rules.issues(supply_graph(spark, sf_dir, parallel=True), RULES).select("rule", "severity", "category", "target")


@query(f"WITH {_NODES}, {_EDGES}, {_ISSUES} SELECT severity, category, rule, count(*) AS n FROM i WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM') GROUP BY ALL")
def severity_summary(spark, sf_dir):
    return inventory.issue_summary(rules.filtered(rules.issues(supply_graph(spark, sf_dir, parallel=True), RULES), "MEDIUM"), ["severity", "category", "rule"])


@query(f"""WITH {_NODES}, {_EDGES}, {_ISSUES} SELECT type, count(*) AS n FROM (SELECT 'HAS_ISSUE' AS type FROM i UNION ALL SELECT 'AFFECTS' FROM i UNION ALL SELECT 'HAS_RECOMMENDATION' FROM i
 UNION ALL SELECT 'Issue' FROM i UNION ALL SELECT 'Recommendation' FROM (SELECT DISTINCT rule FROM i)) GROUP BY type""")
def issue_ledger(spark, sf_dir):
    g = rules.ledger(rules.issues(supply_graph(spark, sf_dir, parallel=True), RULES), "supply/")
    return inventory.type_counts(g).unionByName(inventory.label_counts(g).withColumnRenamed("label", "type"))


@query("""SELECT 'ERROR' AS severity, 'REFERENTIAL_INTEGRITY' AS rule, 'event:'||event_id||' BY customer:'||user_id AS detail FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def referential_integrity(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    ev, cu = (lambda k: F.concat(F.lit("event:"), F.col(k).cast("string"))), (lambda k: F.concat(F.lit("customer:"), F.col(k).cast("string")))
    nodes = t("events").select(ev("event_id").alias("id")).unionByName(t("customer").select(cu("c_custkey").alias("id")))
    return validate.dangling(Graph(nodes, t("events").select(ev("event_id").alias("src"), cu("user_id").alias("dst"), F.lit("BY").alias("type"))))


@query("""SELECT 'WARNING' AS severity, 'ORPHAN' AS rule, 'document:'||doc_id AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_documents(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    key = F.concat(F.lit("document:"), F.col("doc_id").cast("string"))
    nodes = t("documents").select(key.alias("id"), F.lit("document").alias("label"))
    return validate.orphans(Graph(nodes, t("labels").select(key.alias("src"), F.concat(F.lit("label:"), F.col("quality").cast("string")).alias("dst"), F.lit("IS").alias("type"))))


@query("""SELECT 'WARNING' AS severity, 'PROPERTY_TYPE' AS rule, 'part:'||p_partkey||' size '||p_type AS detail FROM part WHERE TRY_CAST(p_type AS BIGINT) IS NULL""")
def property_types(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.create_map(F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("size"), F.col("p_type")).alias("props"))
    return validate.property_types(Graph(p, None), {"price": "double", "size": "long"})


@query(f"WITH {_EDGES}, {_NODES} SELECT 'ERROR' AS severity, 'UNKNOWN_LABEL' AS rule, label AS detail FROM v WHERE label NOT IN ('region', 'nation', 'customer', 'supplier') GROUP BY label UNION ALL SELECT 'ERROR', 'UNKNOWN_TYPE', type FROM e WHERE type NOT IN ('PART_OF', 'LOCATED_IN') GROUP BY type")
def vocabulary(spark, sf_dir):
    return validate.vocabulary(supply_graph(spark, sf_dir), {"region", "nation", "customer", "supplier"}, {"PART_OF", "LOCATED_IN"})


@query("""SELECT severity, rule, n, detail FROM (SELECT 'WARNING' AS severity, 'ORPHAN' AS rule, count(*) AS n, min(x) AS detail FROM (
 SELECT 'part:'||p_partkey AS x FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) HAVING count(*) > 0)
UNION ALL SELECT 'WARNING', 'REQUIRED_TYPE', 1, 'OWNS'""")
def validation_report(spark, sf_dir):
    g = supply_graph(spark, sf_dir, parallel=True)
    checks = {"ids": validate.bad_ids, "ends": validate.dangling, "orphans": lambda g: validate.orphans(g, {"customer", "supplier", "order", "nation", "region"}), "types": lambda g: validate.required(g, {"CONTAINS", "OWNS"})}
    return validate.report(g, checks)[0].select("severity", "rule", "n", F.col("details")[0].alias("detail"))


#: Customers and parts without orders, nations without suppliers, edges between regions, and shares of what is delivered and labelled.
@query(f"""WITH {_EDGES}, {_NODES},
w AS (SELECT 'customer:'||c_custkey AS id, n_regionkey AS estate FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier:'||s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT DISTINCT 'customer:'||o_custkey AS src, 'supplier:'||l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT 'ERROR' AS severity, 'CUSTOMER_WITHOUT_ORDER' AS rule, name AS detail FROM v WHERE label = 'customer' AND id NOT IN (SELECT dst FROM e WHERE type = 'PLACED_BY')
 UNION ALL SELECT 'WARNING', 'ORDER_WITHOUT_PART', name FROM v WHERE label = 'order' AND id NOT IN (SELECT src FROM e WHERE type = 'CONTAINS')
 UNION ALL SELECT 'INFO', 'EDGES_BETWEEN_REGIONS', 'n '||count(*) FROM x JOIN w a ON a.id = x.src JOIN w b ON b.id = x.dst WHERE a.estate <> b.estate HAVING count(*) > 0
 UNION ALL SELECT 'WARNING', 'ORDERS_FINISHED', CAST(round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS VARCHAR) FROM orders HAVING round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) < 80
 UNION ALL SELECT 'WARNING', 'SEVERAL_REGIONS', 'n '||count(*) FROM region HAVING count(*) > 1)
SELECT severity, rule, count(*) AS n, min(detail) AS first FROM f GROUP BY ALL""")
def dialect_gates(spark, sf_dir):
    g, orders, t = supply_graph(spark, sf_dir), table(spark, sf_dir, "orders"), lambda n: table(spark, sf_dir, n)
    of = [t(n).join(t("nation"), F.col(f"{n[0]}_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(n + ":"), F.col(k).cast("string")).alias("id"), F.create_map(F.lit("estate"), F.col("n_regionkey").cast("string")).alias("props")) for n, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    sold = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    found = [
        gates.lacking("customer", ["PLACED_BY"], "ERROR", "CUSTOMER_WITHOUT_ORDER", "dst")(g),
        gates.lacking("order", ["CONTAINS"], "WARNING", "ORDER_WITHOUT_PART")(g),
        gates.number(gates.crossing(Graph(of[0].unionByName(of[1]), sold)), "INFO", "EDGES_BETWEEN_REGIONS", "n > 0"),
        validate.below(gates.percent(orders, F.col("o_orderstatus") == "F"), "pct", 80.0, "WARNING", "ORDERS_FINISHED"),
        gates.number(g.by_label("region"), "WARNING", "SEVERAL_REGIONS", "n > 1"),
    ]
    return gates.united(*found).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("detail").alias("first"))


@query("""SELECT lang, count(*) AS n, count(l.doc_id) AS hits, round(100.0 * count(l.doc_id) / count(*), 1) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def coverage_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return inventory.coverage(d, "lang", F.coalesce("known", F.lit(False)))


@query("""WITH o AS (SELECT DISTINCT 'SALES' AS owner, upper(n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0
 UNION SELECT DISTINCT 'SUPPLY', upper(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 = 0),
r AS (SELECT n_nationkey AS ref_id, CASE WHEN n_nationkey % 5 = 0 THEN 'SUPPLY' END AS owner, n_name AS name FROM nation),
u AS (SELECT name, min(owner) AS owner FROM o GROUP BY name HAVING count(*) = 1)
SELECT r.ref_id, COALESCE(e.owner||'.'||e.name, p.owner||'.'||p.name, u.owner||'.'||u.name) AS object_id,
 CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN p.name IS NOT NULL THEN 'parsing-schema' WHEN u.name IS NOT NULL THEN 'unique-name' ELSE 'unresolved' END AS resolution,
 CAST(CASE WHEN e.name IS NOT NULL THEN 1.0 WHEN p.name IS NOT NULL THEN 0.95 WHEN u.name IS NOT NULL THEN 0.7 ELSE 0.0 END AS DOUBLE) AS confidence
FROM r LEFT JOIN o e ON e.owner = r.owner AND e.name = upper(r.name) LEFT JOIN o p ON r.owner IS NULL AND p.owner = 'SALES' AND p.name = upper(r.name) LEFT JOIN u ON u.name = upper(r.name)""")
def name_resolution_ladder(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    side = lambda n, k, owner, m: t(n).join(t("nation"), F.col(k) == F.col("n_nationkey")).filter(f"n_nationkey % {m} = 0").select(F.lit(owner).alias("owner"), F.upper("n_name").alias("name")).distinct()
    o = side("customer", "c_nationkey", "SALES", 2).unionByName(side("supplier", "s_nationkey", "SUPPLY", 3)).withColumn("object_id", F.concat_ws(".", "owner", "name"))
    refs = t("nation").select(F.col("n_nationkey").alias("ref_id"), F.when(F.col("n_nationkey") % 5 == 0, "SUPPLY").alias("owner"), F.col("n_name").alias("name"))
    none = spark.createDataFrame([], "owner string, name string, table_owner string, table_name string")
    return resolve.resolve_objects(refs, o, none, "SALES").select("ref_id", "object_id", "resolution", "confidence")


def _estates(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)

    def part(rows, key, label, origin):
        agg = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        n = agg.join(t("nation"), F.col(key) == F.col("n_nationkey"))
        props = F.create_map(F.lit("origin"), F.lit(origin), F.lit("members"), F.col("n").cast("string"), F.lit("name"), F.col("n_name"))
        nodes = n.select(F.concat(F.lit("db:"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col("n_name").alias("name"), props.alias("props"), F.col(key).cast("long").alias("ordinal"))
        edges = n.select(F.concat(F.lit("db:"), F.col(key).cast("string")).alias("src"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("PART_OF").alias("type"), F.create_map().cast("map<string,string>").alias("props"), F.col(key).cast("long").alias("ordinal"))
        return Graph(nodes, edges)

    return merge.federate([("sales", part(t("customer"), "c_nationkey", "Market", "ddl")), ("supply", part(t("supplier"), "s_nationkey", "Source", "dictionary"))])


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT 'db:'||COALESCE(c.k, s.k) AS id, CASE WHEN c.k IS NOT NULL THEN 'Market' ELSE 'Source' END AS label, CAST(COALESCE(s.n, c.n) AS VARCHAR) AS members,
 concat_ws(',', CASE WHEN c.k IS NOT NULL THEN 'sales' END, CASE WHEN s.k IS NOT NULL THEN 'supply' END) AS estates FROM c FULL OUTER JOIN s ON c.k = s.k""")
def federated_merge(spark, sf_dir):
    merged, _ = merge.merge_nodes(_estates(spark, sf_dir)[0])
    return merged.select("id", "label", F.col("props")["members"].alias("members"), F.array_join("estates", ",").alias("estates"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT c.k, c.n AS cn, s.n AS sn FROM c JOIN s ON c.k = s.k)
SELECT 'db:'||k AS id, 'members' AS key, CAST(sn AS VARCHAR) AS kept, CAST(cn AS VARCHAR) AS lost, 'authority' AS resolved_by FROM b WHERE cn <> sn
UNION ALL SELECT 'db:'||k, 'label', 'Market', 'Source', 'first' FROM b""")
def merge_conflicts(spark, sf_dir):
    return merge.merge_nodes(_estates(spark, sf_dir)[0])[1].select("id", "key", "kept", "lost", "resolved_by")


@query("""SELECT 'sales/region:'||r_regionkey AS dst, count(DISTINCT c_nationkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
UNION ALL SELECT 'supply/region:'||r_regionkey, count(DISTINCT s_nationkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def federated_edges(spark, sf_dir):
    nodes, edges = _estates(spark, sf_dir)
    ends = edges.select(F.col("dst").alias("id")).distinct().unionByName(nodes.select("id"))
    return merge.merge_edges(edges, ends.distinct()).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 0)
SELECT COALESCE(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p""")
def graph_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    after = o.filter("k % 5 <> 0").withColumn("s", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("s")))
    return merge.diff(o.filter("k % 7 <> 0"), after, "k", ["s", "p"])


@query("""WITH RECURSIVE d AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < c_nationkey), r AS (SELECT n_nationkey AS id, 1 AS wave FROM nation UNION SELECT d.src, r.wave + 1 FROM r JOIN d ON d.dst = r.id)
SELECT CAST(id AS VARCHAR) AS id, CAST(max(wave) AS INTEGER) AS wave FROM r GROUP BY id""")
def migration_waves(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    d = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.filter("s_nationkey < c_nationkey").select(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst")).distinct()
    return traverse.waves(t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").cast("long").alias("ordinal")), d)


_NEXT = "e AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)"


def _transitions(spark, sf_dir):
    e = inventory.following(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "dst")
    return e.select(F.col("event_type").alias("src"), "dst").filter("dst is not null")


@query(f"""WITH RECURSIVE {_NEXT}, t AS (SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL), r AS (SELECT [src, dst] AS p FROM t WHERE src <= dst
 UNION ALL SELECT list_append(p, t.dst) FROM r JOIN t ON t.src = p[-1] WHERE p[1] <> p[-1] AND len(p) < 5 AND ((t.dst > p[1] AND NOT list_contains(p, t.dst)) OR t.dst = p[1]))
SELECT array_to_string(p, '>') AS path FROM r WHERE p[1] = p[-1] AND len(p) >= 3""")
def closed_paths(spark, sf_dir):
    return traverse.paths(_transitions(spark, sf_dir), 2, 4, closed=True).select(F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_NEXT}, t AS (SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL AND src <> dst), r AS (SELECT src, dst FROM t UNION SELECT r.src, t.dst FROM r JOIN t ON r.dst = t.src),
c AS (SELECT a.src AS id, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
SELECT id, least(id, min(other)) AS component FROM c GROUP BY id""")
def cycle_members(spark, sf_dir):
    return traverse.cycle_members(_transitions(spark, sf_dir))


@query("""SELECT 'supplier:'||l_suppkey AS id, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def lineage_two_hop(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.groupBy(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("id")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.array_join(inventory.names("p_brand"), ",").alias("brands"))


@query("""WITH a AS (SELECT user_id AS id, count(*) AS changes FROM events GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS complexity FROM orders GROUP BY 1)
SELECT id, changes, complexity, changes * complexity AS risk FROM a JOIN b USING (id) ORDER BY risk DESC, id LIMIT 25""")
def churn_vs_complexity(spark, sf_dir):
    return inventory.churn(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit(1).alias("value")))


@query("""SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations""")
def next_pair(spark, sf_dir):
    return inventory.following(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role", "next_role")


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) AS INTEGER) AS ordinal FROM documents""")
def nth_occurrence(spark, sf_dir):
    return inventory.nth(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"]).select("doc_id", "ordinal")


@query("""SELECT 'biz:'||lower(n_name) AS id, count(DISTINCT o_orderkey) AS writes, CASE WHEN count(DISTINCT o_orderkey) > 600 THEN 'HIGH' ELSE 'MEDIUM' END AS criticality
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY n_name""")
def business_seed(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    w = t("nation").join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).filter("o_orderstatus = 'F'")
    out = w.groupBy(F.concat(F.lit("biz:"), F.lower("n_name")).alias("id")).agg(F.count_distinct("o_orderkey").alias("writes"))
    return out.withColumn("criticality", F.when(F.col("writes") > 600, "HIGH").otherwise("MEDIUM"))
