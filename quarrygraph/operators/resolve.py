"""Names to objects: ladders of keys, where the first step that knows a name decides.

Every step is a left join with the dictionary on one key. The dictionary's size decides how the joins
run: nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = {"exact": 1.0, "parsing-schema": 0.95, "synonym": 0.9, "unique-name": 0.7, "unresolved": 0.0}


def resolve_objects(refs: DataFrame, objects: DataFrame, synonyms: DataFrame, parsing_schema: str) -> DataFrame:
    """refs (ref_id, owner or null, name) with object_id, resolution and confidence.

    An exact owner and name first; then the parsing schema's object; then a synonym of the owner, the parsing
    schema or PUBLIC, in this order; then a name that only one schema has. objects is (owner, name,
    object_id), synonyms (owner, name, table_owner, table_name).
    """
    r = refs.withColumn("_owner", F.upper(F.coalesce("owner", F.lit("")))).withColumn("_name", F.upper("name"))
    o = objects.select(F.upper("owner").alias("_o"), F.upper("name").alias("_n"), "object_id").dropDuplicates(["_o", "_n"])
    unique = o.groupBy("_n").agg(F.count(F.lit(1)).alias("_c"), F.min("object_id").alias("_unique")).filter("_c = 1").drop("_c")
    s = synonyms.select(F.upper("owner").alias("_so"), F.upper("name").alias("_sn"), F.upper("table_owner").alias("_o"), F.upper("table_name").alias("_n"))
    via = s.join(o, ["_o", "_n"]).select("_so", "_sn", F.col("object_id").alias("_via"))
    schema = F.lit(parsing_schema.upper())
    r = r.join(o.select(F.col("_o").alias("_owner"), F.col("_n").alias("_name"), F.col("object_id").alias("_exact")), ["_owner", "_name"], "left")
    r = r.join(o.filter(F.col("_o") == schema).select(F.col("_n").alias("_name"), F.col("object_id").alias("_parsing")), "_name", "left")
    for k, who in (("_s1", F.col("_owner")), ("_s2", schema), ("_s3", F.lit("PUBLIC"))):
        step = via.select(F.col("_so").alias(k + "o"), F.col("_sn").alias(k + "n"), F.col("_via").alias(k)).dropDuplicates([k + "o", k + "n"])
        r = r.join(step, (F.col(k + "o") == who) & (F.col(k + "n") == F.col("_name")), "left").drop(k + "o", k + "n")
    r = r.join(unique.withColumnRenamed("_n", "_name"), "_name", "left")
    bare = F.col("_owner") == ""
    ladder = [
        ("exact", F.col("_exact")), ("parsing-schema", F.when(bare, F.col("_parsing"))),
        ("synonym", F.coalesce("_s1", "_s2", "_s3")), ("unique-name", F.col("_unique")),
    ]
    how = F.lit("unresolved")
    for name, hit in reversed(ladder):
        how = F.when(hit.isNotNull(), name).otherwise(how)
    sure = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    out = r.withColumn("object_id", F.coalesce(*[h for _, h in ladder])).withColumn("resolution", how).withColumn("confidence", sure[F.col("resolution")])
    return out.select(*refs.columns, "object_id", "resolution", "confidence")


def unresolved(resolved: DataFrame, source: str) -> DataFrame:
    """What isn't known: the reference, its kinds, and from how many sources."""
    return resolved.filter("object_id is null").groupBy(F.upper("name").alias("reference")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("sources"))


def by_suffix(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs (ref_id, path) with the first target (target_id, path, ordinal) whose path ends the reference, or is ended by
    it, at a slash; else the first of the same file stem. Suffixes are keys, so this is an equi-join."""
    tails = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda k: F.array_join(F.slice(F.split(p, "/"), k, F.size(F.split(p, "/"))), "/"))
    r, t = refs.select("ref_id", "path"), targets.select("target_id", F.col("path").alias("tpath"), "ordinal")
    ended = r.withColumn("key", F.explode(tails(F.col("path")))).join(t.withColumn("key", F.col("tpath")), "key")
    ends = r.withColumn("key", F.col("path")).join(t.withColumn("key", F.explode(tails(F.col("tpath")))), "key")
    stem = lambda p: F.regexp_extract(p, r"([^/]+?)(?:\.[^./]*)?$", 1)
    stems = r.withColumn("key", stem(F.col("path"))).join(t.withColumn("key", stem(F.col("tpath"))), "key")
    hits = ended.withColumn("tier", F.lit(1)).unionByName(ends.withColumn("tier", F.lit(1))).unionByName(stems.withColumn("tier", F.lit(2)))
    best = hits.groupBy("ref_id").agg(F.min_by("target_id", F.struct("tier", "ordinal")).alias("target_id"))
    return refs.join(best, "ref_id", "left")


def first_match(refs: DataFrame, tiers: list[tuple[list[str], DataFrame]]) -> DataFrame:
    """refs with target_id of the first tier, a list of key columns and a table of them with target_id and ordinal, that has one."""
    out, hits = refs, []
    for k, (keys, table) in enumerate(tiers):
        w = Window.partitionBy(*keys).orderBy("ordinal")
        one = table.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*keys, F.col("target_id").alias(f"_t{k}"))
        out = out.join(one, keys, "left")
        hits.append(f"_t{k}")
    return out.withColumn("target_id", F.coalesce(*hits)).drop(*hits)
