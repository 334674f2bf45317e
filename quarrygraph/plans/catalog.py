"""Rule catalogues of the integration (T), database (O), application (A) and federated (X) graphs."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..model import Graph
from ..operators.rules import Rule, at_least, where, without
from ..operators.traverse import min_hops

_LITERAL_SECRET = r"(?i)(password|passwd|pwd|secret|api_?key)\s*(:=|=>|=)\s*'[^']+'"


def _p(key: str):
    return F.col("props")[key]


def _is(key: str):
    return F.lower(F.coalesce(_p(key), F.lit("false"))) == "true"


def _external_without_handler(g: Graph):
    calls = g.by_label("Activity").filter(_p("category").isin("DATABASE", "MESSAGING", "HTTP", "SERVICE", "FILE", "MAIL")).select(F.col("id").alias("dst"), _p("category").alias("category"))
    e = g.of_type("CONTAINS_ACTIVITY").join(calls, "dst").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("message"))
    return e.join(g.of_type("HANDLES_ERROR").select("src"), "src", "left_anti").select(F.col("src").alias("target"), "message")


def _idle_process(g: Graph):
    starts = g.of_type("CONTAINS_ACTIVITY").join(g.by_label("Activity").filter(_is("starter")).select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))
    called = g.of_type("INVOKES").select(F.col("dst").alias("id"))
    return g.by_label("Process").join(starts, "id", "left_anti").join(called, "id", "left_anti").select(F.col("id").alias("target"), F.col("name").alias("message"))


def _unbounded_read(g: Graph, least: int = 100_000):
    big = g.by_label("DbTable").filter(_p("numRows").cast("long") >= least).select(F.col("id").alias("dst"), F.col("name").alias("message"))
    open_ = g.by_label("SqlStatement").filter((_p("verb") == "SELECT") & ~_is("hasWhere")).select(F.col("id").alias("src"))
    return g.of_type("READS_FROM").join(big, "dst").join(open_, "src").groupBy(F.col("src").alias("target")).agg(F.min("message").alias("message"))


_REACH = ["CONTAINS", "CONTAINS_REGION", "CONTAINS_ITEM", "CONTAINS_PROCESS", "EXECUTES_SQL", "EXECUTES_PLSQL", "READS_FROM", "WRITES_TO", "CALLS"]


def _open_pages(g: Graph):
    return g.by_label("Page").join(g.of_type("SECURED_BY").select(F.col("src").alias("id")), "id", "left_anti")


def _reaching(g: Graph, roots, kind: str, goal: str | None = None, depth: int = 8):
    """Roots from which an edge of a kind (to a node of a label) is reached."""
    r = min_hops(g.of_type(*_REACH), roots.select("id"), depth).select("root", F.col("id").alias("src"))
    hit = r.join(g.of_type(kind), "src").select(F.col("root").alias("target"), "dst")
    n = g.nodes.select(F.col("id").alias("dst"), "name", "label")
    return hit.join(n.filter(F.col("label") == goal) if goal else n, "dst").groupBy("target").agg(F.min("name").alias("message"))


def _open_items(g: Graph):
    r = min_hops(g.of_type(*_REACH), _open_pages(g).select("id"), 4).join(g.by_label("PageItem").filter(F.coalesce(_p("protectionLevel"), F.lit("N")) == "N").select("id", "name"), "id")
    return r.groupBy(F.col("root").alias("target")).agg(F.min("name").alias("message"))


def _executed(g: Graph, label: str, flag, types=("EXECUTES_SQL", "EXECUTES_PLSQL")):
    """Nodes of a label that run code for which a condition holds."""
    code = g.nodes.filter(flag).select(F.col("id").alias("dst"), F.col("name").alias("message"))
    owner = g.by_label(*label.split("|")).select(F.col("id").alias("src"))
    return g.of_type(*types).join(code, "dst").join(owner, "src").groupBy(F.col("src").alias("target")).agg(F.min("message").alias("message"))


def _excluded_build(g: Graph):
    off = g.by_label("BuildOption").filter(_p("buildOptionStatus") == "EXCLUDE").select(F.col("id").alias("dst"), F.col("name").alias("message"))
    return g.of_type("CONDITIONED_BY").join(off, "dst").select(F.col("src").alias("target"), "message")


def _writers(g: Graph):
    return g.of_type("WRITES_TO").join(g.nodes.select(F.col("id").alias("src"), _p("estate").alias("estate"), F.col("label").alias("by")), "src")


def _contended(g: Graph):
    each = _writers(g).groupBy("dst").agg(F.array_sort(F.collect_set("estate")).alias("e")).filter(F.size("e") > 1)
    return each.select(F.col("dst").alias("target"), F.array_join("e", ", ").alias("message"))


def _committing(g: Graph):
    units = g.by_label("DbProgramUnit").filter(_is("commits")).select(F.col("id").alias("u"))
    own = g.of_type("EXECUTES_SQL").select(F.col("src").alias("u"), F.col("dst").alias("src")).join(units, "u")
    mine = g.of_type("WRITES_TO").join(own, "src").select("dst").distinct()
    theirs = _writers(g).filter("by = 'Activity'").select("dst").distinct()
    return theirs.join(mine, "dst").select(F.col("dst").alias("target"), F.col("dst").alias("message"))


def _same_statement(g: Graph):
    n = g.by_label("SqlStatement").withColumn("key", F.element_at(F.split("id", "/"), -1))
    return n.groupBy("key").agg(F.min("id").alias("target"), F.array_sort(F.collect_set(_p("estate"))).alias("e")).filter(F.size("e") > 1).select("target", F.array_join("e", ", ").alias("message"))


def _read_what_is_written(g: Graph):
    written = _writers(g).filter("by = 'Activity'").select("dst").distinct()
    r = min_hops(g.of_type(*_REACH), g.by_label("Page").select("id"), 8).select("root", F.col("id").alias("src"))
    return r.join(g.of_type("READS_FROM"), "src").join(written, "dst").groupBy(F.col("root").alias("target")).agg(F.min("dst").alias("message"))


def integration() -> list[Rule]:
    return [
        Rule("T-SEC-001", "HIGH", "security", "Embedded credential", "Move it to a vault.", where("SharedResource", _is("embeddedCredential"))),
        Rule("T-SEC-002", "HIGH", "security", "Secret variable with a value", "Set it at deployment.", where("GlobalVariable", F.lower("name").rlike("password|secret|credential|key") & (F.coalesce(_p("value"), F.lit("")) != ""))),
        Rule("T-SEC-003", "MEDIUM", "security", "Endpoint on localhost", "Name the host.", where("SharedResource", F.lower(F.concat_ws(" ", _p("url"), _p("host"))).rlike(r"localhost|127\.0\.0\.1"))),
        Rule("T-CORR-001", "HIGH", "correctness", "External call without error handling", "Add a handler.", _external_without_handler),
        Rule("T-CORR-002", "MEDIUM", "correctness", "Neither started nor called", "Remove or wire it.", _idle_process),
        Rule("T-PERF-001", "MEDIUM", "performance", "All columns selected", "Name the columns.", where("Activity", _p("statement").rlike(r"(?i)select\s+\*"))),
        Rule("T-DEBT-001", "LOW", "debt", "Uncalled process", "Remove it.", where("Process", F.lit(False))),
        Rule("T-DEBT-002", "LOW", "debt", "Unused resource", "Remove it.", without("SharedResource", ["REFERENCES", "CONFIGURED_BY"])),
        Rule("T-DEBT-003", "MEDIUM", "debt", "External reference", "Bring it into the estate.", where("ExternalReference", F.lit(True))),
    ]


def database() -> list[Rule]:
    return [
        Rule("O-SEC-001", "CRITICAL", "security", "Dynamic SQL", "Bind the values.", where("DbProgramUnit", _is("dynamicSql"))),
        Rule("O-SEC-002", "HIGH", "security", "Credential in the source", "Move it to a vault.", where("SqlStatement", _p("text").rlike(_LITERAL_SECRET))),
        Rule("O-CORR-001", "HIGH", "correctness", "Errors are swallowed", "Log and raise.", where("DbProgramUnit", _is("othersNull"))),
        Rule("O-CORR-002", "HIGH", "correctness", "Commit in a trigger", "Leave it to the caller.", where("DbTrigger", _is("commits"))),
        Rule("O-CORR-003", "HIGH", "correctness", "Change of all rows", "Add a condition.", where("SqlStatement", _p("verb").isin("UPDATE", "DELETE") & ~_is("hasWhere"))),
        Rule("O-PERF-001", "MEDIUM", "performance", "All columns selected", "Name the columns.", where("SqlStatement", _is("selectStar"))),
        Rule("O-PERF-002", "MEDIUM", "performance", "Optimizer hint", "Review it.", where("SqlStatement", _is("hint"))),
        Rule("O-PERF-003", "HIGH", "performance", "Unbounded read of a large table", "Add a condition.", _unbounded_read),
        Rule("O-DEBT-001", "MEDIUM", "debt", "Specification without a body", "Write or drop it.", without("DbPackage", ["DECLARES"], incoming=False)),
        Rule("O-DEBT-002", "LOW", "debt", "Uncalled unit", "Drop it.", without("DbProgramUnit", ["CALLS"])),
        Rule("O-DEBT-003", "HIGH", "debt", "Invalid object", "Compile it.", lambda g: g.nodes.filter(_p("status") == "INVALID").select(F.col("id").alias("target"), F.col("name").alias("message"))),
        Rule("O-DEBT-004", "LOW", "debt", "Unresolved reference", "Find its source.", where("UnresolvedReference", F.lit(True))),
    ]


def application() -> list[Rule]:
    return [
        Rule("A-SEC-001", "CRITICAL", "security", "Dynamic SQL joins input", "Bind the values.", where("PlsqlBlock", _is("dynamicSql") & _is("concatenatesInput"))),
        Rule("A-SEC-002", "HIGH", "security", "Unsecured page writes", "Secure it.", lambda g: _reaching(g, _open_pages(g), "WRITES_TO")),
        Rule("A-SEC-003", "HIGH", "security", "Open page with unprotected items", "Protect them.", _open_items),
        Rule("A-SEC-004", "HIGH", "security", "Public page reaches data", "Require a login.", lambda g: _reaching(g, g.by_label("Page").filter((_p("pageIsPublicYN") == "Y") & (F.coalesce(_p("id"), F.lit("")) != "101")), "READS_FROM")),
        Rule("A-SEC-005", "MEDIUM", "security", "Unprotected key item", "Protect it.", where("PageItem", (F.upper(_p("isPrimaryKey")) == "Y") & (F.coalesce(_p("protectionLevel"), F.lit("N")) == "N"))),
        Rule("A-SEC-006", "MEDIUM", "security", "Unused authorization", "Use or drop it.", without("Authorization", ["SECURED_BY"])),
        Rule("A-SEC-007", "MEDIUM", "security", "Substitution in text", "Bind the item.", where("Region", F.size(F.array_except(F.regexp_extract_all(F.coalesce(_p("plugSource"), F.lit("")), F.lit(r"&([A-Z][A-Z0-9_]*)\."), 1), F.array(*map(F.lit, ["APP_ID", "APP_PAGE_ID", "APP_SESSION", "SESSION", "DEBUG", "REQUEST", "APP_USER", "APP_ALIAS"])))) > 0)),
        Rule("A-SEC-008", "LOW", "security", "Item named like a credential", "Encrypt it.", where("PageItem", F.lower("name").rlike("password|secret|token|credential"))),
        Rule("A-PERF-001", "HIGH", "performance", "Region selects all columns", "Name them.", lambda g: _executed(g, "Region", _is("selectStar"))),
        Rule("A-PERF-002", "HIGH", "performance", "Column on a list of values", "Join instead.", lambda g: g.of_type("USES_LOV").join(g.by_label("ReportColumn").select(F.col("id").alias("src"), F.col("name").alias("message")), "src").select(F.col("src").alias("target"), "message")),
        Rule("A-PERF-003", "HIGH", "performance", "Report over a large table", "Filter it.", lambda g: _reaching(Graph(g.nodes, g.edges.join(g.nodes.filter(_p("numRows").cast("long") > 100_000).select(F.col("id").alias("dst")), "dst", "left_semi").unionByName(g.edges.filter("type <> 'READS_FROM'"))), g.by_label("Region"), "READS_FROM", depth=3)),
        Rule("A-PERF-004", "MEDIUM", "performance", "Many joins and no bind", "Bind a value.", where("SqlStatement", (_p("joinCount").cast("int") >= 5) & (_p("bindCount").cast("int") == 0))),
        Rule("A-PERF-005", "MEDIUM", "performance", "Optimizer hint", "Review it.", where("SqlStatement", _is("hint"))),
        Rule("A-PERF-006", "MEDIUM", "performance", "Statement of many components", "Share a view.", at_least("SqlStatement", ["EXECUTES_SQL"], 5)),
        Rule("A-PERF-008", "MEDIUM", "performance", "Database link", "Copy the data.", where("SqlStatement", _is("dbLink"))),
        Rule("A-CORR-003", "HIGH", "correctness", "Errors are swallowed", "Log and raise.", where("PlsqlBlock", _is("othersNull"))),
        Rule("A-CORR-004", "MEDIUM", "correctness", "Commit in a process", "Leave it to the engine.", lambda g: _executed(g, "PageProcess|DynamicActionAction", _is("commits"), ("EXECUTES_PLSQL",))),
        Rule("A-CORR-006", "MEDIUM", "correctness", "Button that does nothing", "Wire it.", without("Button", ["TRIGGERS"], incoming=False, predicate="props['buttonAction'] = 'SUBMIT'")),
        Rule("A-DEBT-001", "MEDIUM", "debt", "Page that nothing leads to", "Link or drop it.", without("Page", ["NAVIGATES_TO"], predicate="coalesce(props['id'], '') not in ('0', '1', '101')")),
        Rule("A-DEBT-002", "LOW", "debt", "Unused list of values", "Drop it.", without("Lov", ["USES_LOV"])),
        Rule("A-DEBT-003", "LOW", "debt", "Switched off by a build option", "Drop it.", _excluded_build),
        Rule("A-DEBT-006", "MEDIUM", "debt", "Block of several components", "Make it a unit.", at_least("PlsqlBlock", ["EXECUTES_PLSQL"], 3)),
    ]


def federated() -> list[Rule]:
    return [
        Rule("X-001", "HIGH", "data", "Written by several estates", "Name one owner.", _contended),
        Rule("X-002", "HIGH", "data", "Unmodelled table", "Extract its schema.", without("TableReference", ["RESOLVES_TO"], incoming=False)),
        Rule("X-003", "HIGH", "data", "Written by integration and by committing code", "Agree on transactions.", _committing),
        Rule("X-004", "MEDIUM", "data", "The same statement in several estates", "Share it.", _same_statement),
        Rule("X-005", "MEDIUM", "data", "Unmapped datasource", "Map it.", without("SharedResource", ["CONNECTS_TO_SCHEMA"], incoming=False, predicate="lower(props['type']) like '%jdbc%'")),
        Rule("X-006", "MEDIUM", "data", "Activity without static SQL", "Review it.", where("Activity", (_p("category") == "DATABASE") & _p("statement").isNull())),
        Rule("X-007", "HIGH", "data", "Page reads what integration writes", "Check freshness.", _read_what_is_written),
    ]


#: Catalogues by kind of graph; each is made when it is asked for, as its conditions need a session.
ALL = {"integration": integration, "database": database, "application": application, "federated": federated}
