"""Source trees as tables of files: path, ext, kind, text, digest, size."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = {".git", ".svn", "node_modules", "target", "build", "dist", "__pycache__", ".idea"}
KINDS = {
    "sql": "sql", "ddl": "sql", "tab": "sql", "vw": "sql", "pks": "plsql", "pkb": "plsql", "pls": "plsql", "plb": "plsql", "prc": "plsql", "fnc": "plsql", "trg": "plsql", "typ": "plsql", "tps": "plsql", "tpb": "plsql",
    "process": "process5", "bwp": "process6", "xsd": "schema", "aeschema": "schema", "wsdl": "service", "substvar": "variables", "xsl": "transform", "xslt": "transform", "json": "dictionary",
}
_DEPLOYMENT = r"(?i)(^|/)(install|deploy|rollback|uninstall|grants?)[^/]*\.sql$"


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark; where that isn't valid, Windows Latin-1."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "windows-1252")), "^﻿", "")


def scan(spark: SparkSession, root: str, most: int = 2_000_000) -> DataFrame:
    """Files under a folder, without those in ignored folders. Larger files have no text; skip says why one is left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape("/" + root.split("://")[-1].strip("/") + "/")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/"), "^" + base, "")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])[ext]
    shared = ext.startswith("shared") | ext.endswith("resource")
    out = f.select(path.alias("path"), ext.alias("ext"), F.when(shared, "resource").otherwise(kind).alias("kind"), "length", F.sha1("content").alias("digest"), F.when(F.col("length") <= most, decoded(F.col("content"))).alias("text"))
    for d in IGNORED:
        out = out.filter(~F.concat(F.lit("/"), "path").contains(f"/{d}/"))
    skip = F.when(F.col("kind").isNull(), "extension").when(F.col("path").rlike(_DEPLOYMENT), "deployment").when(F.col("text").isNull(), "size")
    return out.withColumn("skip", skip)


def dataset_id(files: DataFrame) -> DataFrame:
    """Twelve digits that change when any file does."""
    return files.agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list("digest")), "")), 1, 12).alias("dataset"))


def by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def export_kind(text: Column, path: Column) -> Column:
    """What an application export script holds, by its beginning, else by its path."""
    head = F.substring(text, 1, 8192)
    return (
        F.when(head.rlike(r"(?i)create_flow\s*\("), "application").when(head.rlike(r"(?i)create_page\s*\("), "page")
        .when(head.rlike(r"(?i)\b(wwv_flow_imp|wwv_flow_api|wwv_flow_imp_shared|wwv_flow_imp_page)\b"), "component").when(head.rlike(r"(?i)^\s*create\s"), "database")
        .when(path.contains("/pages/"), "page").when(path.contains("/shared_components/"), "component").otherwise("other")
    )


def file_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File and Directory nodes and CONTAINS_FILE edges from each folder to what is in it."""
    none = F.create_map().cast("map<string,string>")
    parent = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    f = files.select("path", "digest", "length")
    nodes = f.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("label"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.create_map(F.lit("path"), F.col("path"), F.lit("digest"), F.col("digest"), F.lit("size"), F.col("length").cast("string")).alias("props"), F.lit(0).cast("long").alias("ordinal"))
    parts = F.split(parent(F.col("path")), "/")
    dirs = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).filter("path <> ''").distinct()
    d = dirs.select(F.concat(F.lit("dir:"), "path").alias("id"), F.lit("Directory").alias("label"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.create_map(F.lit("path"), F.col("path")).alias("props"), F.lit(0).cast("long").alias("ordinal"))
    edge = lambda t, kind: t.select(F.concat(F.lit("dir:"), parent(F.col("path"))).alias("src"), F.concat(F.lit(kind), "path").alias("dst"), F.lit("CONTAINS_FILE").alias("type"), none.alias("props"), F.lit(0).cast("long").alias("ordinal")).filter("src <> 'dir:'")
    return nodes.unionByName(d), edge(f, "file:").unionByName(edge(dirs, "dir:"))


def git_log(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """commit, author, at, subject and path of each changed file of a captured log, whose heads are fields parted by 0x1F and
    whose files follow, one a line."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\x1e")).alias("entry")).filter(F.trim("entry") != "")
    lines = F.split(F.trim("entry"), "\n")
    head = F.split(lines[0], "\x1f")
    files = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: F.trim(x) != "")
    out = raw.select(head[0].alias("commit"), head[1].alias("author"), head[2].alias("at"), head[3].alias("subject"), F.explode_outer(files).alias("path"))
    return out.withColumn("path", F.when(F.col("path").startswith(prefix), F.col("path").substr(F.lit(len(prefix) + 1), F.length("path"))).otherwise(F.col("path")))
