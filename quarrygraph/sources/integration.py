"""Integration-process definitions as a graph: two generations of process files, schemas, services, shared resources and variables.

XML is read in Arrow-batched Python that gives one flat table of facts (kind, name, attributes); everything else is joins.
Values that are secrets never leave the reader: what comes out is that there is one.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqltext import sql_facts
from ..model import Graph, present

FACT = "array<struct<kind:string,name:string,owner:string,target:string,props:map<string,string>>>"
_CATEGORIES = {
    "jdbc": "DATABASE", "jms": "MESSAGING", "http": "HTTP", "rest": "HTTP", "soap": "SERVICE", "service": "SERVICE", "file": "FILE", "ftp": "FILE", "mail": "MAIL", "smtp": "MAIL", "timer": "TIMER",
    "mapper": "TRANSFORM", "xml": "TRANSFORM", "parse": "TRANSFORM", "render": "TRANSFORM", "log": "LOGGING", "java": "CODE", "callprocess": "CALL", "subprocess": "CALL", "generateerror": "ERROR", "catch": "ERROR",
}
_SECRET = ("password", "secret", "credential", "key")
WEIGHTS = {"INVOKES": 1.0, "CONTAINS_ACTIVITY": 1.0, "TRANSITIONS_TO": 0.3, "USES_XSD": 0.7, "REFERENCES": 0.6, "CONFIGURED_BY": 0.6, "USES_VARIABLE": 0.4, "EXPOSES": 0.8, "READS_FROM": 0.8, "WRITES_TO": 0.9}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(e: ET.Element, *names: str) -> str:
    for n in names:
        for c in e.iter():
            if _local(c.tag).lower() == n and c.text and c.text.strip():
                return c.text.strip()
    return ""


def category(kind: str) -> str:
    low = kind.lower().replace(".", "").replace("-", "")
    return next((c for k, c in _CATEGORIES.items() if k in low), "CUSTOM")


def _fact(kind: str, name: str, owner: str = "", target: str = "", **props: str) -> dict:
    return {"kind": kind, "name": name, "owner": owner, "target": target, "props": {k: str(v) for k, v in props.items() if v not in (None, "", False)}}


def _unique(name: str, seen: dict[str, int]) -> str:
    seen[name] = seen.get(name, 0) + 1
    return name if seen[name] == 1 else f"{name}_{seen[name]}"


def _process5(root: ET.Element, path: str) -> Iterator[dict]:
    name = _text(root, "name") or path
    yield _fact("process", name, "", "", generation="5", namespace=root.get("targetNamespace", ""))
    for e in root.iter():
        tag = _local(e.tag)
        if tag in ("activity", "starter"):
            kind = _text(e, "type", "resourcetype")
            activity = e.get("name") or _text(e, "name")
            sql = _text(e, "statement", "sqlstatement")
            yield _fact("activity", activity, name, "", type=kind, category=category(kind), starter=tag == "starter", statement=sql, file=_text(e, "filename"))
            if called := _text(e, "processname"):
                yield _fact("invokes", activity, name, called)
            if shared := _text(e, "jdbcsharedconfig", "connectionreference", "sharedresource", "connection"):
                yield _fact("uses_resource", activity, name, shared)
        elif tag == "transition":
            yield _fact("transition", _text(e, "from"), name, _text(e, "to"), condition=_text(e, "conditiontype"))
        elif tag == "catch" or "errorhandler" in tag.lower():
            yield _fact("handler", e.get("name") or "catch", name)


def _process6(root: ET.Element, path: str) -> Iterator[dict]:
    name = root.get("name") or path
    yield _fact("process", name, "", "", generation="6", namespace=root.get("targetNamespace", ""))
    seen: dict[str, int] = {}
    links: dict[str, dict[str, str]] = {}

    def walk(e: ET.Element) -> str:
        """The name of the activity that the element is, if it is one."""
        tag, here = _local(e.tag), ""
        if tag in ("extensionActivity", "invoke", "receive", "reply", "pick", "throw", "exit", "assign", "empty"):
            inner = next((x for x in e.iter() if x is not e and (x.get("activityTypeID") or x.get("processName") or x.get("name"))), e)
            config = next((x.get("activityTypeID") for x in e.iter() if x.get("activityTypeID")), tag)
            here = _unique(e.get("name") or inner.get("name") or tag, seen)
            sql = next((v for x in e.iter() for k, v in x.attrib.items() if "sqlstatement" in k.lower()), "") or _text(e, "sqlstatement", "statement")
            found.append(_fact("activity", here, name, "", type=config, category=category(config), starter=tag in ("receive", "pick") or e.get("createInstance") == "yes", statement=sql))
            for x in e.iter():
                if x.get("processName"):
                    found.append(_fact("invokes", here, name, x.get("processName")))
                for k, v in x.attrib.items():
                    if k.lower().endswith("sharedresource") or k == "property" and "resource" in v.lower():
                        found.append(_fact("uses_resource", here, name, v))
        elif tag in ("faultHandlers", "catch", "catchAll"):
            found.append(_fact("handler", e.get("faultName") or tag, name))
        for x in e:
            if _local(x.tag) in ("source", "target") and x.get("linkName") or _local(x.tag) in ("sources", "targets"):
                for y in [x, *x]:
                    if y.get("linkName") and here:
                        links.setdefault(y.get("linkName"), {})[_local(y.tag)] = here
        before = ""
        if not here:
            for x in e:
                now = walk(x)
                if tag == "sequence" and before and now:
                    found.append(_fact("transition", before, name, now))
                before = now or before
        return here

    found: list[dict] = []
    walk(root)
    yield from found
    for ends in links.values():
        if "source" in ends and "target" in ends:
            yield _fact("transition", ends["source"], name, ends["target"])


def _schema(root: ET.Element, path: str) -> Iterator[dict]:
    yield _fact("schema", path, "", "", namespace=root.get("targetNamespace", ""))
    seen = set()
    for e in root:
        tag = _local(e.tag)
        if tag in ("element", "complexType", "simpleType") and e.get("name") and (tag, e.get("name")) not in seen:
            seen.add((tag, e.get("name")))
            yield _fact("element" if tag == "element" else "type", e.get("name"), path, "", type=e.get("type", ""))
        elif tag in ("import", "include") and e.get("schemaLocation"):
            yield _fact("imports", path, path, e.get("schemaLocation"))


def _service(root: ET.Element, path: str) -> Iterator[dict]:
    style = address = ""
    for e in root.iter():
        style = e.get("style") or style if _local(e.tag) == "binding" else style
        address = e.get("location") or address if _local(e.tag) == "address" else address
    yield _fact("service", root.get("name") or path, "", "", namespace=root.get("targetNamespace", ""), style=style, endpoint=address)
    for e in root.iter():
        if _local(e.tag) == "operation" and e.get("name"):
            yield _fact("operation", e.get("name"), root.get("name") or path)
        elif _local(e.tag) == "import" and (e.get("location") or e.get("schemaLocation")):
            yield _fact("imports", path, path, e.get("location") or e.get("schemaLocation"))


def _resource(root: ET.Element, path: str) -> Iterator[dict]:
    pairs = [(_local(e.tag), (e.text or "").strip()) for e in root.iter()] + [(_local(k), v) for e in root.iter() for k, v in e.attrib.items()]
    first = lambda *names: next((v for k, v in pairs if k.lower() in names and v), "")
    secret = any(any(s in k.lower() for s in _SECRET) and v for k, v in pairs)
    yield _fact("resource", root.get("name") or first("name") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "", "", type=path.rsplit(".", 1)[-1], url=first("url", "dburl", "location", "providerurl"), driver=first("driver", "jdbcdriver"), host=first("host"), embeddedCredential=str(secret).lower())


def _variables(root: ET.Element, path: str) -> Iterator[dict]:
    seen = set()
    for e in root.iter():
        if _local(e.tag) == "globalVariable":
            name, value = _text(e, "name"), _text(e, "value")
            if name not in seen:
                seen.add(name)
                secret = any(s in name.lower() for s in _SECRET)
                yield _fact("variable", name, path.split("/")[0], "", value="***MASKED***" if secret and value else value, type=_text(e, "type"), deploymentSettable=_text(e, "deploymentsettable"))


_READERS = {"process5": _process5, "process6": _process6, "schema": _schema, "service": _service, "resource": _resource, "variables": _variables}


def read(kind: str, path: str, text: str) -> list[dict]:
    """Facts of one file; none of one that isn't XML."""
    try:
        root = ET.fromstring((text or "").encode())
    except ET.ParseError:
        return []
    return [f for f in _READERS[kind](root, path) if f["name"]] if kind in _READERS else []


def facts(files: DataFrame) -> DataFrame:
    """path, module, position and the fact, of files (path, kind, text)."""
    reader = F.udf(read, FACT, useArrow=True)
    rows = files.filter(F.col("kind").isin(*_READERS)).select("path", F.posexplode(reader("kind", "path", "text")).alias("position", "f"))
    return rows.select("path", F.split("path", "/")[0].alias("module"), "position", "f.*")


_LABELS = {"process": "Process", "activity": "Activity", "schema": "Schema", "element": "SchemaElement", "type": "SchemaType", "service": "Service", "operation": "Operation", "resource": "SharedResource", "variable": "GlobalVariable", "handler": "ErrorHandler"}


def integration_graph(files: DataFrame) -> Graph:
    """Nodes with counter ids in the order of paths and positions; edges of containment, flow, calls, configuration and table access."""
    f = facts(files)
    label = F.create_map(*[x for k, v in _LABELS.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    w = Window.partitionBy("kind").orderBy("path", "position")  # one row a component
    made = f.filter(F.col("kind").isin(*_LABELS)).withColumn("label", label).withColumn("n", F.row_number().over(w)).withColumn("id", F.format_string("%s_%04d", F.col("kind"), F.col("n")))
    made = made.withColumn("full", F.concat_ws("/", F.nullif("owner", F.lit("")), "name"))
    nodes = made.select("id", "label", "name", F.map_concat(present(F.col("props")), F.create_map(F.lit("path"), F.col("path"), F.lit("module"), F.col("module"))).alias("props"), F.col("n").cast("long").alias("ordinal"))
    modules = f.select("module").distinct().select(F.concat(F.lit("module:"), "module").alias("id"), F.lit("Module").alias("label"), F.col("module").alias("name"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0).cast("long").alias("ordinal"))
    none = F.create_map().cast("map<string,string>")
    edge = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("type"), none.alias("props"), F.lit(0).cast("long").alias("ordinal"))
    of = lambda kind: made.filter(F.col("kind") == kind)
    owner = of("process").select(F.col("id").alias("src"), "path")
    parts = [edge(made.filter(F.col("kind").isin("process", "schema", "service", "resource", "variable")).select(F.concat(F.lit("module:"), "module").alias("src"), F.col("id").alias("dst")), "CONTAINS")]
    for kind, name in (("activity", "CONTAINS_ACTIVITY"), ("handler", "HANDLES_ERROR")):
        parts.append(edge(of(kind).select(F.col("id").alias("dst"), "path").join(owner, "path"), name))
    for parent, kind, name in (("schema", "element", "DEFINES"), ("schema", "type", "DEFINES"), ("service", "operation", "EXPOSES")):
        parts.append(edge(of(kind).select(F.col("id").alias("dst"), "path").join(of(parent).select(F.col("id").alias("src"), "path"), "path"), name))
    act = of("activity").select("path", F.col("name").alias("activity"), "id")
    flow = f.filter("kind = 'transition'").join(act.withColumnRenamed("id", "src"), ["path"]).filter("name = activity").drop("activity").join(act.withColumnRenamed("id", "dst"), ["path"]).filter("target = activity")
    parts.append(edge(flow, "TRANSITIONS_TO"))
    # a called process by path, by stem, by name
    stem = lambda c: F.regexp_extract(c, r"([^/.]+)(?:\.[A-Za-z]+)?$", 1)
    goals = of("process").select(F.col("id").alias("goal"), "path", F.explode(F.array_distinct(F.array(F.lower("path"), F.lower(stem(F.col("path"))), F.lower("name")))).alias("key"), "n").groupBy("key").agg(F.min_by("goal", "n").alias("dst"))
    call = f.filter("kind = 'invokes'").join(owner, "path").withColumn("key1", F.lower("target")).withColumn("key2", F.lower(stem(F.col("target"))))
    call = call.join(goals.select(F.col("key").alias("key1"), F.col("dst").alias("d1")), "key1", "left").join(goals.select(F.col("key").alias("key2"), F.col("dst").alias("d2")), "key2", "left")
    call = call.withColumn("dst", F.coalesce("d1", "d2", F.concat(F.lit("external:"), "target")))
    parts.append(edge(call, "INVOKES"))
    gone = call.filter("dst like 'external:%'").groupBy(F.col("dst").alias("id")).agg(F.min("target").alias("name"))
    gone = gone.select("id", F.lit("ExternalReference").alias("label"), "name", none.alias("props"), F.lit(0).cast("long").alias("ordinal"))
    res = of("resource").select(F.col("id").alias("dst"), F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(stem(F.col("path"))), F.lower("path")))).alias("key"))
    uses = f.filter("kind = 'uses_resource'").withColumn("key", F.lower(stem(F.col("target")))).join(act.withColumnRenamed("id", "src"), "path").filter("name = activity").join(res, "key")
    parts.append(edge(uses.select("src", "dst").distinct(), "CONFIGURED_BY"))
    sql = of("activity").filter(F.col("props")["statement"].isNotNull()).select(F.col("id").alias("src"), sql_facts(F.col("props")["statement"]).alias("s")).select("src", F.explode("s.tables").alias("t"))
    access = sql.select("src", F.concat(F.lit("table:"), "t.name").alias("dst"), F.when(F.col("t.access") == "READ", "READS_FROM").otherwise("WRITES_TO").alias("type"), none.alias("props"), F.lit(0).cast("long").alias("ordinal"))
    tables = access.groupBy(F.col("dst").alias("id")).agg(F.lit("TableReference").alias("label")).select("id", "label", F.substring("id", 7, 1000).alias("name"), none.alias("props"), F.lit(0).cast("long").alias("ordinal"))
    used = made.select(F.col("id").alias("src"), F.explode(F.flatten(F.transform(F.map_values("props"), lambda v: F.regexp_extract_all(v, F.lit("%%([^%]+)%%"), 1)))).alias("key")).withColumn("key", F.lower(stem(F.col("key"))))
    variables = of("variable").select(F.col("id").alias("dst"), F.lower(stem(F.col("name"))).alias("key"))
    parts.append(edge(used.join(variables, "key").select("src", "dst").distinct(), "USES_VARIABLE"))
    edges = access
    for p in parts:
        edges = edges.unionByName(p)
    return Graph(nodes.unionByName(modules).unionByName(gone).unionByName(tables), edges)
