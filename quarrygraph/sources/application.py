"""Low-code application exports as a graph: every call of the export API is a row, every component a projection of some calls.

A procedure's projection is data (PROCEDURES), so a new one is a line; procedures without a line are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, sqltext
from ..model import Graph, present

#: procedure -> (label, prefix of ids, argument of the name, parent: page, region, application or list, kept arguments)
PROCEDURES = {
    "create_flow": ("Application", "app", "name", None, ["alias", "owner", "authentication"]),
    "create_build_option": ("BuildOption", "bo", "buildOptionName", "application", ["buildOptionStatus"]),
    "create_authentication": ("Authentication", "authn", "name", "application", ["schemeType"]),
    "create_security_scheme": ("Authorization", "authz", "name", "application", ["schemeType", "attribute01"]),
    "create_flow_item": ("AppItem", "item", "name", "application", ["protectionLevel"]),
    "create_flow_process": ("AppProcess", "proc", "processName", "application", ["processType", "processSqlClob"]),
    "create_flow_computation": ("AppComputation", "comp", "computationItem", "application", ["computationType", "computation"]),
    "create_page": ("Page", "page", "name", "application", ["alias", "pageMode", "requiredRole", "protectionLevel", "pageIsPublicYN"]),
    "create_page_plug": ("Region", "reg", "plugName", "page", ["plugSource", "plugSourceType", "queryType", "queryTable", "sqlQuery", "requiredRole", "requiredPatch"]),
    "create_report_columns": ("ReportColumn", "col", "columnAlias", "region", ["columnHeading", "lovNamed"]),
    "create_worksheet_column": ("ReportColumn", "col", "dbColumnName", "region", ["columnLabel", "rpnNamedLov"]),
    "create_region_column": ("ReportColumn", "col", "name", "region", ["sourceExpression", "lovId"]),
    "create_page_item": ("PageItem", "item", "name", "page", ["source", "sourceType", "displayAs", "namedLov", "lov", "protectionLevel", "isPrimaryKey", "itemPlugId"]),
    "create_page_button": ("Button", "btn", "buttonName", "page", ["buttonAction", "buttonRedirectUrl", "databaseAction"]),
    "create_page_process": ("PageProcess", "proc", "processName", "page", ["processType", "processSqlClob", "processWhenButtonId"]),
    "create_page_computation": ("Computation", "comp", "computationItem", "page", ["computationType", "computation"]),
    "create_page_validation": ("Validation", "val", "validationName", "page", ["validation", "validationType", "associatedItem"]),
    "create_page_branch": ("Branch", "branch", "branchName", "page", ["branchAction", "branchType"]),
    "create_page_da_event": ("DynamicAction", "da", "name", "page", ["triggeringElement", "bindEventType"]),
    "create_page_da_action": ("DynamicActionAction", "daa", "action", "page", ["attribute01", "affectedElements", "eventId"]),
    "create_list_of_values": ("Lov", "lov", "lovName", "application", ["lovQuery", "sourceType"]),
    "create_list": ("List", "list", "name", "application", []),
    "create_list_item": ("ListEntry", "entry", "listItemLinkText", "list", ["listItemLinkTarget"]),
    "create_nav_bar_list_item": ("ListEntry", "entry", "listItemLinkText", "application", ["listItemLinkTarget"]),
    "create_web_source_module": ("WebSource", "web", "name", "application", ["urlPathPrefix"]),
    "create_web_source_operation": ("WebSourceOperation", "webop", "operation", "application", ["databaseOperation"]),
    "create_automation": ("Automation", "auto", "name", "application", ["querySource", "schedule"]),
    "create_automation_action": ("AutomationAction", "autoact", "name", "application", ["actionClob"]),
    "create_plugin": ("Plugin", "plugin", "name", "application", ["plsqlCode"]),
    "create_email_template": ("EmailTemplate", "mail", "name", "application", []),
}
#: Arguments that hold SQL and PL/SQL.
SQL_ARGS, PLSQL_ARGS = ("sqlQuery", "lovQuery", "lov", "querySource", "plugSource"), ("processSqlClob", "computation", "validation", "attribute01", "actionClob", "plsqlCode")
RUNTIME = frozenset({"APEX_UTIL", "APEX_APPLICATION", "APEX_ERROR", "APEX_JSON", "APEX_MAIL", "HTP", "OWA_UTIL", "DBMS_OUTPUT", "WWV_FLOW_API"})
WEIGHTS = {"CONTAINS_REGION": 1.0, "CONTAINS_ITEM": 0.8, "CONTAINS_PROCESS": 1.0, "CONTAINS": 0.9, "EXECUTES_SQL": 1.0, "EXECUTES_PLSQL": 1.0, "READS_FROM": 0.8, "WRITES_TO": 0.9, "CALLS": 1.0, "NAVIGATES_TO": 0.4, "USES_LOV": 0.6, "SECURED_BY": 0.3, "BINDS_ITEM": 0.5, "CONDITIONED_BY": 0.3}


def calls(files: DataFrame) -> DataFrame:
    """Calls of the export files (path, text) in order, each with the application and page that it comes after."""
    c = files.select("path", F.posexplode(sqltext.export_calls(F.col("text"))).alias("pos", "c")).select("path", "pos", "c.*")
    value = F.udf(lambda args: {k: None if (v := sqltext.parse_value(x)) is None else str(v) for k, x in (args or {}).items()}, "map<string,string>", useArrow=True)
    c = c.withColumn("args", present(value("args")))
    w = Window.partitionBy("path").orderBy("pos")
    carry = lambda p, k: F.last(F.when(F.col("procedure") == p, F.col("args")[k]), ignorenulls=True).over(w)
    c = c.withColumn("app", F.coalesce(carry("component_begin", "defaultApplicationId"), carry("create_flow", "id"), F.lit("0")))
    for name, p in (("page", "create_page"), ("region", "create_page_plug"), ("list", "create_list")):
        c = c.withColumn(name, carry(p, "id"))
    return c.withColumn("ordinal", 100_000 * F.dense_rank().over(Window.orderBy("path")) + F.col("pos"))  # one row a component


def unhandled(called: DataFrame) -> DataFrame:
    known = [*PROCEDURES, "component_begin", "component_end", "import_begin", "import_end", "create_static_lov_data"]
    return called.filter(F.col("procedure").startswith("create_") & ~F.col("procedure").isin(*known)).groupBy("procedure").agg(F.count(F.lit(1)).alias("n"))


def url_page(url: Column) -> Column:
    """The page that an f?p address or a friendly one leads to."""
    classic = F.regexp_extract(url, r"f\?p=[^:]*:([^:]*)", 1)
    redirect = F.regexp_extract(url, r"redirect/([^:/?]+)", 1)
    found = F.when(classic != "", classic).otherwise(redirect)
    return F.when(found.rlike(r"^\d+$"), found)


def url_items(url: Column) -> Column:
    """Names of the items that an f?p address sets."""
    return F.filter(F.split(F.upper(F.try_element_at(F.split(url, ":"), F.lit(7))), ","), lambda x: x.rlike(r"^[A-Z][A-Z0-9_$#]*$"))


def components(called: DataFrame) -> DataFrame:
    """id, label, name, parent, props and ordinal of every component."""
    parts = []
    for procedure, (label, prefix, name, parent, keep) in PROCEDURES.items():
        c = called.filter(F.col("procedure") == procedure)
        own = F.coalesce(F.col("args")["id"], F.sha1(F.concat_ws("|", "path", F.col("pos").cast("string"))))
        id_ = F.concat_ws(":", F.lit(prefix), "app", own) if procedure != "create_flow" else F.concat(F.lit("app:"), F.coalesce(F.col("args")["id"], F.col("app")))
        up = {"application": F.concat(F.lit("app:"), "app"), "page": F.concat_ws(":", F.lit("page"), "app", "page"), "region": F.concat_ws(":", F.lit("reg"), "app", "region"), "list": F.concat_ws(":", F.lit("list"), "app", "list")}.get(parent, F.lit(None).cast("string"))
        held = F.map_filter("args", lambda k, _: k.isin(*keep, "id")) if keep else F.map_filter("args", lambda k, _: k == "id")
        parts.append(c.select(id_.alias("id"), F.lit(label).alias("label"), F.coalesce(F.col("args")[name], own).alias("name"), up.alias("parent"), held.alias("props"), "app", "page", "ordinal"))
    return reduce(DataFrame.unionByName, parts)


def _edge(df: DataFrame, kind, confidence: float | None = None) -> DataFrame:
    props = F.create_map(F.lit("confidence"), F.lit(str(confidence))) if confidence else F.create_map().cast("map<string,string>")
    return df.select("src", "dst", (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), props.alias("props"), F.lit(0).cast("long").alias("ordinal"))


def application_graph(files: DataFrame) -> Graph:
    """Components, their code, and what they contain, run, secure, navigate to, and read and write."""
    called = calls(files)
    c = components(called)
    nodes = [c.select("id", "label", "name", "props", F.col("ordinal").cast("long"))]
    kind = F.when(F.col("label") == "Region", "CONTAINS_REGION").when(F.col("label") == "PageItem", "CONTAINS_ITEM").when(F.col("label") == "PageProcess", "CONTAINS_PROCESS").otherwise("CONTAINS")
    edges = [_edge(c.filter("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"), "label"), kind)]
    # code, one node for equal text
    arg = lambda keys: F.filter(F.transform(F.array(*[F.col("props")[k] for k in keys]), lambda x: x), lambda x: x.isNotNull() & (F.trim(x) != ""))
    sql = c.select("id", "app", "page", F.explode(arg(SQL_ARGS)).alias("text")).filter(F.lower("text").rlike(r"^\s*(select|with)\b")).withColumn("norm", sqltext.normalised_sql(F.col("text"))).withColumn("code", ids.content_id("sql", F.col("norm")))
    block = c.filter("coalesce(props['schemeType'], '') not like '%EXISTS%'").select("id", "app", "page", F.explode(arg(PLSQL_ARGS)).alias("text")).filter(F.lower("text").rlike(r"\b(begin|return|:=)|;")).withColumn("norm", sqltext.normalised_sql(F.col("text"))).withColumn("code", ids.content_id("plsql", F.col("norm")))
    s = sql.dropDuplicates(["code"]).withColumn("f", sqltext.sql_facts(F.col("text")))
    b = block.dropDuplicates(["code"]).withColumn("f", sqltext.plsql_facts(F.col("text"), RUNTIME))
    code = lambda df, label, props: df.select(F.col("code").alias("id"), F.lit(label).alias("label"), F.substring("norm", 1, 120).alias("name"), props.alias("props"), F.lit(0).cast("long").alias("ordinal"))
    text = lambda **kv: present(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]))
    nodes.append(code(s, "SqlStatement", text(verb=F.col("f.verb"), selectStar=F.col("f.select_star"), hint=F.col("f.hint"), dbLink=F.col("f.db_link"), joinCount=F.col("f.joins"), bindCount=F.size("f.binds"), status=F.col("f.status"))))
    nodes.append(code(b, "PlsqlBlock", text(othersNull=F.col("f.others_null"), commits=F.col("f.commits"), dynamicSql=F.col("f.dynamic_sql"), concatenatesInput=F.col("f.concatenates"))))
    edges += [_edge(sql.select(F.col("id").alias("src"), F.col("code").alias("dst")).distinct(), "EXECUTES_SQL"), _edge(block.select(F.col("id").alias("src"), F.col("code").alias("dst")).distinct(), "EXECUTES_PLSQL")]
    tables = s.select(F.col("code").alias("src"), F.explode("f.tables").alias("t")).unionByName(b.select(F.col("code").alias("src"), F.explode("f.statements").alias("x")).select("src", F.explode("x.tables").alias("t")))
    tables = tables.unionByName(c.filter(F.col("props")["queryTable"].isNotNull()).select(F.col("id").alias("src"), F.struct(F.lit("").alias("owner"), F.upper(F.col("props")["queryTable"]).alias("name"), F.lit("READ").alias("access"), F.lit("").alias("alias"), F.lit("").alias("link")).alias("t")))
    access = tables.select("src", F.concat(F.lit("table:"), "t.name").alias("dst"), F.when(F.col("t.access") == "READ", "READS_FROM").otherwise("WRITES_TO").alias("k")).distinct()
    edges.append(_edge(access, F.col("k")))
    named = lambda df, label, cut: df.groupBy(F.col("dst").alias("id")).agg(F.lit(label).alias("label")).select("id", "label", F.substring("id", cut, 1000).alias("name"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0).cast("long").alias("ordinal"))
    nodes.append(named(access, "TableReference", 7))
    called_units = b.select(F.col("code").alias("src"), F.explode("f.calls").alias("u")).select("src", F.concat(F.lit("unit:"), "u").alias("dst")).distinct()
    edges.append(_edge(called_units, "CALLS"))
    nodes.append(named(called_units, "UnitReference", 6))
    # items that code binds: of the page, of the application, of any page
    binds = s.select("code", F.explode("f.binds").alias("item")).join(sql.select("code", "id", "app", "page"), "code").unionByName(b.select("code", F.explode(F.flatten(F.transform("f.statements", lambda x: x["binds"]))).alias("item")).join(block.select("code", "id", "app", "page"), "code"))
    item = c.filter(F.col("label").isin("PageItem", "AppItem")).select("app", F.upper("name").alias("item"), F.col("id").alias("goal"), F.col("page").alias("at"), "label", "ordinal")
    near = binds.join(item, ["app", "item"]).withColumn("tier", F.when(F.col("at").eqNullSafe(F.col("page")) & (F.col("label") == "PageItem"), 1).when(F.col("label") == "AppItem", 2).otherwise(3))
    edges.append(_edge(near.groupBy(F.col("id").alias("src"), "item").agg(F.min_by("goal", F.struct("tier", "ordinal")).alias("dst")), "BINDS_ITEM", 0.9))
    # deferred references by name or id
    prop = lambda k: F.col("props")[k]
    for label, keys, how in (("Authorization", ("requiredRole",), "SECURED_BY"), ("Lov", ("namedLov", "lovNamed", "rpnNamedLov", "lovId"), "USES_LOV"), ("BuildOption", ("requiredPatch",), "CONDITIONED_BY")):
        goal = c.filter(F.col("label") == label).select("app", F.explode(F.array_distinct(F.array(F.upper("name"), prop("id")))).alias("key"), F.col("id").alias("dst")).dropDuplicates(["app", "key"])
        edges.append(_edge(c.select("app", F.col("id").alias("src"), F.upper(F.coalesce(*[prop(k) for k in keys])).alias("key")).filter("key is not null").join(goal, ["app", "key"]), how))
    targets = c.select("app", F.col("id").alias("src"), url_page(F.coalesce(prop("branchAction"), prop("buttonRedirectUrl"), prop("listItemLinkTarget"))).alias("to")).filter("to is not null")
    goal = c.filter("label = 'Page'").select(F.col("app"), prop("id").alias("to"), F.col("id").alias("dst"))
    edges.append(_edge(targets.join(goal, ["app", "to"]), "NAVIGATES_TO"))
    fired = c.filter(prop("processWhenButtonId").isNotNull()).select("app", F.col("id").alias("dst"), F.concat_ws(":", F.lit("btn"), "app", prop("processWhenButtonId")).alias("src"))
    edges.append(_edge(fired, "TRIGGERS", 0.95))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Graph(union(nodes), union(edges))


def page_complexity(graph: Graph, reached: DataFrame, weights: dict[str, float]) -> DataFrame:
    """id, score, fan_out and depth of pages, from what each reaches (root, id, hops)."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    rows = reached.filter("hops > 0").join(graph.nodes.select("id", "label"), "id")
    return rows.groupBy(F.col("root").alias("id")).agg(F.round(F.sum(F.coalesce(w[F.col("label")], F.lit(0.0))), 1).alias("score"), F.count_if(F.col("hops") == 1).alias("fan_out"), F.max("hops").alias("depth"))
