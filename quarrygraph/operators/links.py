"""Links between estates: datasources to schemas, activities to resources, and table names to database objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def map_datasources(resources: DataFrame, mapping: DataFrame) -> DataFrame:
    """resources (resource_id, name, qualified_name, url) with the schema of the first entry (resource, schema, url_contains,
    position) whose name is the resource's, or whose text is part of its URL. Names are keys; only entries with a text, which are
    written by hand, meet every resource."""
    keys = resources.select("resource_id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("key"))
    named = keys.join(mapping.withColumn("key", F.lower("resource")), "key").select("resource_id", "schema", "position")
    texts = mapping.filter("url_contains is not null and url_contains <> ''").select("schema", "position", F.lower("url_contains").alias("part"))
    by_url = resources.select("resource_id", F.lower("url").alias("url")).join(texts, F.contains(F.col("url"), F.col("part"))).select("resource_id", "schema", "position")
    best = named.unionByName(by_url).groupBy("resource_id").agg(F.min_by("schema", "position").alias("schema"))
    return resources.join(best, "resource_id", "left").withColumn("mapped", F.col("schema").isNotNull())


def bind_activities(activities: DataFrame, references: DataFrame, resources: DataFrame) -> DataFrame:
    """activities (activity_id, process_id, resource or null) with resource_id: the one named, else the only JDBC resource that its
    process refers to (process_id, resource); two or more decide nothing."""
    byname = resources.select("resource_id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("key")).dropDuplicates(["key"])
    only = references.select("process_id", F.lower("resource").alias("key")).join(byname, "key").groupBy("process_id").agg(F.count_distinct("resource_id").alias("n"), F.min("resource_id").alias("only")).filter("n = 1")
    a = activities.withColumn("key", F.lower("resource")).join(byname.withColumnRenamed("resource_id", "named"), "key", "left").drop("key")
    return a.join(only.select("process_id", "only"), "process_id", "left").withColumn("resource_id", F.coalesce("named", F.when(F.col("resource").isNull(), F.col("only")))).drop("named", "only")


def bind_tables(names: DataFrame, objects: DataFrame) -> DataFrame:
    """names (source, table, access, schema or null) with object_id, basis and reason.

    With a schema, its object of that name (qualified-name); without, the only object of the name in any (name); else the
    reason is no-such-object or ambiguous-name. objects is (owner, name, object_id, ordinal)."""
    n = names.withColumn("_t", F.upper(F.element_at(F.split("table", r"\."), -1))).withColumn("_s", F.upper(F.coalesce(F.when(F.size(F.split("table", r"\.")) > 1, F.split("table", r"\.")[0]), F.col("schema"))))
    w = Window.partitionBy("_s", "_t").orderBy("ordinal")
    first = objects.select(F.upper("owner").alias("_s"), F.upper("name").alias("_t"), F.col("object_id").alias("_exact"), "ordinal").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "ordinal")
    byname = objects.groupBy(F.upper("name").alias("_t")).agg(F.count_distinct("object_id").alias("_n"), F.min("object_id").alias("_only"))
    out = n.join(first, ["_s", "_t"], "left").join(byname, "_t", "left")
    bare = F.col("_s").isNull()
    hit = F.coalesce("_exact", F.when(bare & (F.col("_n") == 1), F.col("_only")))
    reason = F.when(hit.isNotNull(), None).when(F.col("_n").isNull() | ~bare, "no-such-object").otherwise("ambiguous-name")
    basis = F.when(F.col("_exact").isNotNull(), "qualified-name").when(hit.isNotNull(), "name")
    return out.select(*names.columns, hit.alias("object_id"), basis.alias("basis"), reason.alias("reason"))


CONFIDENCE = {"qualified-name": 0.95, "name": 0.6}


def cross_estate(bound: DataFrame, accept: tuple[str, ...] = ("qualified-name",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of the accepted bases, matches that are held back, and what isn't bound, of bind_tables()."""
    sure = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    verb = F.create_map(*[x for k, v in {"READ": "READS_FROM", "INSERT": "INSERTS_INTO", "UPDATE": "UPDATES", "DELETE": "DELETES_FROM"}.items() for x in (F.lit(k), F.lit(v))])
    hit = bound.filter("object_id is not null").select(F.col("source").alias("src"), F.col("object_id").alias("dst"), verb[F.col("access")].alias("type"), "basis", sure[F.col("basis")].alias("confidence"))
    edges = hit.filter(F.col("basis").isin(*accept))
    edges = edges.unionByName(edges.filter("type <> 'READS_FROM'").withColumn("type", F.lit("WRITES_TO"))).distinct()
    return edges, hit.filter(~F.col("basis").isin(*accept)), bound.filter("object_id is null").select("source", "table", "reason")


def bind_coverage(bound: DataFrame, datasources: DataFrame) -> DataFrame:
    """Percent of sources with SQL that are bound, and of datasources that are mapped."""
    pct = lambda a, b: F.when(b == 0, F.lit(100.0)).otherwise(F.round(100.0 * a / b, 1))
    by = bound.groupBy("source").agg(F.bool_or(F.col("object_id").isNotNull()).alias("hit"))
    a = by.agg(F.count(F.lit(1)).alias("with_sql"), F.count_if("hit").alias("bound"))
    d = datasources.agg(F.count(F.lit(1)).alias("datasources"), F.count_if("mapped").alias("mapped"))
    return a.crossJoin(d).withColumn("sql_bind", pct(F.col("bound"), F.col("with_sql"))).withColumn("datasource", pct(F.col("mapped"), F.col("datasources")))  # one row each


def cutover(writers: DataFrame, reads: DataFrame) -> DataFrame:
    """component and wave, 0 to 3: what writes nothing and reads nothing shared goes first; then readers of shared tables; then what
    writes tables of its own estate only; last what writes a table that other estates write too. Both are (component, estate, table)."""
    shared = writers.groupBy("table").agg(F.count_distinct("estate").alias("n")).filter("n > 1").select("table", F.lit(True).alias("shared"))
    w = writers.join(shared, "table", "left").groupBy("component").agg(F.lit(True).alias("writes"), F.bool_or(F.coalesce("shared", F.lit(False))).alias("contends"))
    r = reads.join(shared, "table", "left").groupBy("component").agg(F.bool_or(F.coalesce("shared", F.lit(False))).alias("reads_shared"))
    every = writers.select("component").unionByName(reads.select("component")).distinct().join(w, "component", "left").join(r, "component", "left")
    return every.select("component", F.when(F.col("contends"), 3).when(F.col("writes"), 2).when(F.col("reads_shared"), 1).otherwise(0).alias("wave"))
