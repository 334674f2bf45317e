"""DDL and PL/SQL scripts as a graph.

Only the lexers are Python; objects, units and statements are tables, names are resolved by joins, and
access, calls and dependencies are projections of what was resolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, sqltext
from ..model import Graph, present
from ..operators.resolve import resolve_objects
from ..operators.shared import Rounds

VERBS = {"READ": "READS_FROM", "INSERT": "INSERTS_INTO", "UPDATE": "UPDATES", "DELETE": "DELETES_FROM"}
WEIGHTS = {"READS_FROM": 0.8, "WRITES_TO": 0.9, "CALLS": 1.0, "DEPENDS_ON": 0.9, "REFERENCES_TABLE": 0.7, "FIRES_ON": 0.8, "EXECUTES_SQL": 1.0, "RESOLVES_TO": 1.0, "INDEXES": 0.2}
STRUCTURAL = {"CONTAINS", "HAS_COLUMN", "DECLARES"}
_LABEL = {"TABLE": "DbTable", "VIEW": "DbView", "MATERIALIZED_VIEW": "DbView", "SEQUENCE": "DbSequence", "SYNONYM": "DbSynonym", "INDEX": "DbIndex", "TRIGGER": "DbTrigger", "TYPE": "DbType", "TYPE_BODY": "DbType", "PACKAGE": "DbPackage", "PACKAGE_BODY": "DbPackage", "DATABASE_LINK": "DbLink"}


def _map(**kv: Column) -> Column:
    return present(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]))


def _nodes(df: DataFrame, id_: Column, label, name: Column, props: Column, ordinal: Column) -> DataFrame:
    return df.select(id_.alias("id"), (F.lit(label) if isinstance(label, str) else label).alias("label"), name.alias("name"), props.alias("props"), ordinal.cast("long").alias("ordinal"))


def _edges(df: DataFrame, src: Column, dst: Column, kind, props: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    return df.select(
        src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        (props if props is not None else F.create_map().cast("map<string,string>")).alias("props"), (ordinal if ordinal is not None else F.lit(0)).cast("long").alias("ordinal"),
    )


def objects(files: DataFrame, owner: str = "APP") -> DataFrame:
    """One row for each object that the scripts (path, text) create, in the order of paths and lines. The window over all
    has one row an object: the catalogue of a schema, not its data."""
    each = files.select("path", F.posexplode(sqltext.ddl_objects(F.col("text"), owner)).alias("pos", "o")).select("path", "pos", "o.*")
    return each.withColumn("object_id", ids.object_id(F.col("owner"), F.col("name"))).withColumn("ordinal", F.col("line") + 1_000_000 * F.dense_rank().over(Window.orderBy("path")))


def units(objs: DataFrame) -> DataFrame:
    """Program units of objects with a body: package units, procedures and functions, triggers. The second and later units of a name in a package
    carry their number."""
    inside = objs.filter(F.col("kind").isin("PACKAGE_BODY", "PROCEDURE", "FUNCTION")).select("path", "owner", F.when(F.col("kind") == "PACKAGE_BODY", F.col("name")).alias("package"), "ordinal", F.posexplode("units").alias("at", "u"))
    inside = inside.select("path", "owner", "package", F.col("u.name").alias("name"), F.col("u.kind").alias("unit_kind"), F.col("u.text").alias("text"), (F.col("ordinal") + F.col("u.line")).alias("ordinal"), "at")
    trig = objs.filter("kind = 'TRIGGER'").select("path", "owner", F.lit(None).cast("string").alias("package"), "name", F.lit("TRIGGER").alias("unit_kind"), "text", "ordinal", F.lit(0).alias("at"))
    w = Window.partitionBy("owner", "package", "name").orderBy("ordinal", "at")
    every = inside.unionByName(trig).withColumn("n", F.row_number().over(w))
    return every.withColumn("unit_id", F.when(F.col("unit_kind") == "TRIGGER", ids.object_id(F.col("owner"), F.col("name"))).otherwise(ids.unit_id(F.col("owner"), F.col("package"), F.col("name"), F.col("n"))))


def metrics(text: Column) -> dict[str, Column]:
    """loc, branches, loops and complexity of a unit's text."""
    upper = F.upper(text)
    n = lambda p: F.size(F.regexp_extract_all(upper, F.lit(p), 0))
    branches, loops = n(r"\b(IF|ELSIF|CASE|WHEN)\b"), n(r"\b(LOOP|WHILE|FORALL)\b")
    loc = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return {"loc": loc, "branches": branches, "loops": loops, "complexity": F.round(1 + branches + 1.5 * loops + loc / 50, 1)}


def database_graph(files: DataFrame, owner: str = "APP", runtime: frozenset[str] = frozenset({"DBMS_OUTPUT", "DBMS_SQL", "UTL_FILE", "DBMS_LOB"})) -> Graph:
    """Nodes and edges of all objects, units and statements. What a name means is decided by joins; a name without an object is an
    UnresolvedReference node."""
    rounds = Rounds(files.sparkSession)
    objs = rounds.hold(objects(files, owner))
    made = objs.filter(F.col("kind").isin(*_LABEL))
    label = F.create_map(*[x for k, v in _LABEL.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    us = rounds.hold(units(objs).withColumn("f", sqltext.plsql_facts(F.col("text"), runtime)))
    flags = {k: F.col(f"f.{c}") for k, c in (("hasExceptionHandler", "exception"), ("othersNull", "others_null"), ("commits", "commits"), ("dynamicSql", "dynamic_sql"), ("concatenatesInput", "concatenates"))}
    trigger = us.filter("unit_kind = 'TRIGGER'").select(F.col("unit_id").alias("object_id"), "ordinal", F.lit("TRIGGER").alias("kind"), _map(**flags).alias("_flags"))
    flagged = made.join(trigger, ["object_id", "ordinal", "kind"], "left")
    node_parts = [
        _nodes(objs.filter("kind <> 'UNPARSED'").select("owner").distinct(), F.concat(F.lit("schema:"), "owner"), "DbSchema", F.col("owner"), _map(origin=F.lit("ddl")), F.lit(0)),
        _nodes(flagged, F.col("object_id"), label, F.col("name"), F.map_concat(_map(owner=F.col("owner"), path=F.col("path"), line=F.col("line"), origin=F.lit("ddl"), target=F.when(F.col("kind") != "VIEW", F.col("target"))), F.coalesce("_flags", F.create_map().cast("map<string,string>"))), F.col("ordinal")),
    ]
    column = objs.filter("kind = 'TABLE'").select("object_id", "ordinal", F.explode("columns").alias("c"))
    column_id = F.concat("object_id", F.lit("."), "c.name")
    node_parts.append(_nodes(column, column_id, "DbColumn", F.col("c.name"), _map(dataType=F.col("c.type"), nullable=F.col("c.nullable"), position=F.col("c.position")), F.col("ordinal") + F.col("c.position")))
    m = metrics(F.col("text"))
    node_parts.append(_nodes(us.filter("unit_kind <> 'TRIGGER'"), F.col("unit_id"), "DbProgramUnit", F.col("name"), _map(owner=F.col("owner"), package=F.col("package"), unitKind=F.col("unit_kind"), path=F.col("path"), **m, **flags), F.col("ordinal")))
    edge_parts = [
        _edges(made, F.concat(F.lit("schema:"), "owner"), F.col("object_id"), "CONTAINS"),
        _edges(column, F.col("object_id"), column_id, "HAS_COLUMN"),
        _edges(us.filter("package is not null"), ids.object_id(F.col("owner"), F.col("package")), F.col("unit_id"), "DECLARES"),
        _edges(us.filter("package is null and unit_kind <> 'TRIGGER'"), F.concat(F.lit("schema:"), "owner"), F.col("unit_id"), "CONTAINS"),
    ]
    # statements, one node for equal text
    st = us.select("unit_id", F.explode("f.statements").alias("s")).withColumn("statement_id", ids.content_id("sql", F.col("s.text")))
    views = objs.filter("kind in ('VIEW', 'MATERIALIZED_VIEW')").withColumn("s", sqltext.sql_facts(F.col("target")))
    s = st.dropDuplicates(["statement_id"])
    node_parts.append(_nodes(s, F.col("statement_id"), "SqlStatement", F.substring("s.text", 1, 120), _map(verb=F.col("s.verb"), text=F.col("s.text"), selectStar=F.col("s.select_star"), hint=F.col("s.hint"), dbLink=F.col("s.db_link"), joinCount=F.col("s.joins"), hasWhere=F.col("s.has_where"), status=F.col("s.status"), bindCount=F.size("s.binds")), F.lit(0)))
    edge_parts.append(_edges(st.select("unit_id", "statement_id").distinct(), F.col("unit_id"), F.col("statement_id"), "EXECUTES_SQL"))
    # references to objects
    refs = reduce(DataFrame.unionByName, [
        s.select(F.col("statement_id").alias("source"), F.explode("s.tables").alias("t")).select("source", F.nullif(F.col("t.owner"), F.lit("")).alias("owner"), F.col("t.name").alias("name"), F.col("t.access").alias("kind")),
        s.select(F.col("statement_id").alias("source"), F.explode("s.sequences").alias("q")).select("source", F.lit(None).cast("string").alias("owner"), F.element_at(F.split("q", r"\."), -1).alias("name"), F.lit("SEQUENCE").alias("kind")),
        views.select(F.col("object_id").alias("source"), F.explode("s.tables").alias("t")).select("source", F.nullif(F.col("t.owner"), F.lit("")).alias("owner"), F.col("t.name").alias("name"), F.lit("DEPENDS").alias("kind")),
        objs.filter("kind in ('TABLE', 'ALTER_TABLE')").select(F.col("object_id").alias("source"), F.explode("foreign_keys").alias("k")).select("source", F.lit(None).cast("string").alias("owner"), F.col("k.target").alias("name"), F.lit("FK").alias("kind")),
        objs.filter("kind in ('INDEX', 'TRIGGER', 'SYNONYM')").select(F.col("object_id").alias("source"), F.when(F.size(F.split("target", r"\.")) > 1, F.split("target", r"\.")[0]).alias("owner"), F.element_at(F.split("target", r"\."), -1).alias("name"), F.col("kind")),
    ])
    known = made.filter(~F.col("kind").isin("PACKAGE_BODY", "TYPE_BODY", "SYNONYM")).select("owner", "name", "object_id")
    target = F.split("target", r"\.")
    syn = objs.filter("kind = 'SYNONYM'").select("owner", "name", F.when(F.size(target) > 1, target[0]).otherwise(F.col("owner")).alias("table_owner"), F.element_at(target, -1).alias("table_name"))
    resolved = rounds.hold(resolve_objects(refs, known, syn, owner))
    hit = resolved.filter("object_id is not null")
    kinds = {**VERBS, "SEQUENCE": "USES_SEQUENCE", "DEPENDS": "DEPENDS_ON", "FK": "REFERENCES_TABLE", "INDEX": "INDEXES", "TRIGGER": "FIRES_ON", "SYNONYM": "RESOLVES_TO"}
    kind = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    sure = _map(resolution=F.col("resolution"), confidence=F.col("confidence"))
    edge_parts.append(_edges(hit, F.col("source"), F.col("object_id"), kind, sure))
    edge_parts.append(_edges(hit.filter(F.col("kind").isin("INSERT", "UPDATE", "DELETE")), F.col("source"), F.col("object_id"), "WRITES_TO", sure))
    columns = s.select("statement_id", F.explode("s.columns").alias("c")).select("statement_id", F.col("c.table").alias("name"), F.col("c.name").alias("column"))
    tables = hit.filter(F.col("kind").isin(*VERBS)).select(F.col("source").alias("statement_id"), "name", "object_id").distinct()
    col_ids = column.select(column_id.alias("id"))
    edge_parts.append(_edges(columns.join(tables, ["statement_id", "name"]).withColumn("id", F.concat("object_id", F.lit("."), "column")).join(col_ids, "id", "left_semi"), F.col("statement_id"), F.col("id"), "REFERENCES_COLUMN"))
    # calls
    call = us.select(F.col("unit_id").alias("source"), F.col("owner").alias("at"), F.col("package").alias("own"), F.explode("f.calls").alias("call"))
    p = F.split("call", r"\.")
    call = call.select("source", "at", "own", "call", F.element_at(p, -1).alias("name"), F.when(F.size(p) > 1, F.element_at(p, -2)).alias("pack"))
    goal = us.filter("unit_kind <> 'TRIGGER'").groupBy("owner", "package", "name").agg(F.min_by("unit_id", "ordinal").alias("goal"), F.count(F.lit(1)).alias("overloads"))
    own = goal.select(F.col("owner").alias("at"), F.col("package").alias("own"), "name", F.col("goal").alias("g1"), F.col("overloads").alias("o1"))
    pack = goal.filter("package is not null").groupBy("package", "name").agg(F.min("goal").alias("g2"), F.max("overloads").alias("o2")).withColumnRenamed("package", "pack")
    lone = goal.filter("package is null").groupBy("name").agg(F.min("goal").alias("g3"))
    found = call.join(pack, ["pack", "name"], "left").join(own.filter("own is not null"), ["at", "own", "name"], "left").join(lone, "name", "left")
    found = rounds.hold(found.withColumn("goal", F.when(F.col("pack").isNotNull(), F.coalesce("g2", F.when(F.col("pack") == F.col("at"), F.col("g3")))).otherwise(F.coalesce("g1", "g3"))).withColumn("ambiguous", F.coalesce("o2", "o1", F.lit(1)) > 1))
    edge_parts.append(_edges(found.filter("goal is not null and goal <> source").select("source", "goal", "ambiguous").distinct(), F.col("source"), F.col("goal"), "CALLS", _map(ambiguous=F.col("ambiguous"))))
    lost = resolved.filter("object_id is null").select(F.concat_ws(".", "owner", "name").alias("ref"), F.when(F.col("kind").isin(*VERBS), "table").otherwise(F.lower("kind")).alias("kind"), "source").unionByName(
        found.filter("goal is null and pack is not null").select(F.col("call").alias("ref"), F.lit("unit").alias("kind"), "source")
    )
    gone = lost.groupBy("ref").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_distinct("source").alias("n"))
    node_parts.append(_nodes(gone, F.concat(F.lit("unresolved:"), "ref"), "UnresolvedReference", F.col("ref"), _map(kinds=F.array_join("kinds", ", "), sources=F.col("n")), F.lit(0)))
    edge_parts.append(_edges(lost.select("source", "ref").distinct(), F.col("source"), F.concat(F.lit("unresolved:"), "ref"), "UNRESOLVED"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Graph(rounds.hold(union(node_parts)), rounds.hold(union(edge_parts))).deduplicated()


def dictionary(spark, path: str) -> dict[str, DataFrame]:
    """Sections of a data-dictionary extract in JSON, each as a table."""
    fields = {
        "objects": "owner string, name string, objectType string, status string", "tables": "owner string, tableName string, numRows long, partitioned string",
        "columns": "owner string, tableName string, columnName string, dataType string, dataLength long, nullable string, columnId int",
        "programUnits": "owner string, packageName string, name string, unitKind string, argumentCount int", "synonyms": "owner string, synonymName string, tableOwner string, tableName string",
        "dependencies": "owner string, name string, type string, referencedOwner string, referencedName string, referencedType string",
        "constraints": "owner string, constraintName string, constraintType string, tableName string, refTable string, refOwner string, columns string",
        "indexes": "owner string, indexName string, tableName string, uniqueness string, columns string", "sequences": "owner string, sequenceName string", "triggers": "owner string, triggerName string, tableOwner string, tableName string",
    }
    schema = ", ".join(f"{k} array<struct<{v.replace(' ', ':').replace(',:', ',')}>>" for k, v in fields.items())
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return {k: doc.select(F.explode(k).alias("x")).select("x.*") for k in fields}


def with_dictionary(graph: Graph, sections: dict[str, DataFrame]) -> Graph:
    """What the dictionary says over what the scripts say: its row counts and states win, and its objects that no script has are added."""
    o = sections["objects"].select(ids.object_id(F.col("owner"), F.col("name")).alias("id"), F.upper("name").alias("dname"), F.col("objectType").alias("kind"), "status", F.col("owner").alias("downer"))
    t = sections["tables"].select(ids.object_id(F.col("owner"), F.col("tableName")).alias("id"), "numRows", "partitioned")
    known = o.join(t, "id", "full")
    label = F.create_map(*[x for k, v in _LABEL.items() for x in (F.lit(k.replace("_", " ")), F.lit(v))])[F.col("kind")]
    extra = _map(status=F.col("status"), numRows=F.col("numRows"), partitioned=F.col("partitioned"), dictionary=F.when(F.col("dname").isNotNull(), "true"))
    both = graph.nodes.join(known, "id", "full")
    nodes = both.select(
        "id", F.coalesce("label", label, F.lit("DbTable")).alias("label"), F.coalesce("name", "dname", F.element_at(F.split("id", r"\."), -1)).alias("name"),
        F.map_concat(F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(extra, k), F.lit(False))), F.coalesce(extra, F.create_map().cast("map<string,string>"))).alias("props"),
        F.coalesce("ordinal", F.lit(1 << 50)).cast("long").alias("ordinal"),
    )
    return Graph(nodes, graph.edges, graph.meta)


def coverage(graph: Graph) -> DataFrame:
    """Shares, in percent, of statements understood, references resolved and calls resolved."""
    n = graph.nodes.agg(F.count_if((F.col("label") == "SqlStatement") & (F.col("props")["status"] == "PARSED")).alias("parsed"), F.count_if(F.col("label") == "SqlStatement").alias("statements"), F.count_if(F.col("label") == "UnresolvedReference").alias("unresolved"))
    e = graph.edges.agg(F.count_if(F.col("type").isin("READS_FROM", "WRITES_TO", "DEPENDS_ON", "REFERENCES_TABLE", "USES_SEQUENCE")).alias("resolved"), F.count_if(F.col("type") == "UNRESOLVED").alias("missed"), F.count_if(F.col("type") == "CALLS").alias("calls"))
    pct = lambda a, b: F.when(b == 0, F.lit(100.0)).otherwise(F.round(100.0 * a / b, 1))
    return n.crossJoin(e).select(  # one row each
        pct(F.col("parsed"), F.col("statements")).alias("parseQuality"), pct(F.col("resolved"), F.col("resolved") + F.col("missed")).alias("resolutionCoverage"), "calls", "unresolved"
    )
