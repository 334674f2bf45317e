"""Line deduplication by site-relative frequency (operator 8).

Pages are grouped by host. A line's share is the number of the host's pages that contain it,
divided by all pages of the host; lines whose share is over a boilerplate ratio, and that are on a
least number of pages, are dropped from every page of the host.

Lines are counted by (host, hash) after each page has named its lines once, with partial sums
before the shuffle, so neither a hot host nor a hot line gathers rows in one task. A host can't have
more boilerplate lines than its pages' average number of lines over the ratio, so they are one
small array a host. That table is broadcast only if the optimizer finds it under
spark.sql.autoBroadcastJoinThreshold; beyond that the join is salted, so that a hot host is spread.

Defined results: null text stays null and its page counts for the host; a text is cut at line
feeds only; lines of white space alone are never dropped; a text all of whose lines go becomes
empty. Null is a host like any other. Repeated rows are separate pages. Lines are told apart by a 64-bit hash within their host.
An empty table gives no rows. Columns may have any names; dedup_lines() adds n_lines and n_removed in place of columns
called so, which without_boilerplate() keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

RATIO, LEAST_PAGES, SALTS = 0.05, 5, 16


def _spoken(line: Column) -> Column:
    """Whether a line has anything but ASCII white space."""
    return line.rlike("[^ \\t\\n\\x0B\\f\\r]")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row a host that has boilerplate lines: the host and their hashes."""
    p = pages.select(F.col(quoted(host)).alias("_host"), F.col(quoted(text)).alias("_text"))
    hashes = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), _spoken), lambda x: F.xxhash64(x)))
    counted = p.select("_host", F.explode(hashes).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_pages)
    totals = p.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")).withColumnRenamed("_host", "_site")
    return (
        counted.join(totals, F.col("_host").eqNullSafe(F.col("_site")))
        .filter(F.col("_n") > ratio * F.col("_pages")).groupBy("_host").agg(F.collect_set("_line").alias("_drop"))
    )


def _dropped(pages: DataFrame, host: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    """_page (a row of pages, as one struct, so none of its columns can clash with those used here), its new _text, and _n and _gone, its lines and those dropped."""
    # written first, so that its real size, not an estimate, says how it is joined: pages only move if it is large
    drop = materialize(boilerplate(pages, host, text, ratio, least_pages), "boilerplate").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    page = pages.select(F.struct(*(F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(pages.columns))).alias("_page"), F.col(quoted(host)).alias("_site"), F.col(quoted(text)).alias("_text"))
    salted = page.withColumn("_at", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int"))
    joined = salted.join(drop, (F.col("_at") == F.col("_salt")) & F.col("_site").eqNullSafe(F.col("_host")), "left")
    kept = F.filter(F.split("_text", "\n"), lambda x: ~(F.array_contains("_drop", F.xxhash64(x)) & _spoken(x)))
    out = joined.withColumn("_lines", F.split("_text", "\n")).withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept).otherwise(F.col("_lines")))
    count = lambda c: F.when(F.col("_text").isNull(), F.lit(0)).otherwise(c).cast("long")
    new = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    return out.select("_page", new.alias("_text"), count(F.size("_lines")).alias("_n"), count(F.size("_lines") - F.size("_kept")).alias("_gone"))


def _columns(pages: DataFrame, text: str, without: tuple[str, ...] = ()) -> list[Column]:
    return [(F.col("_text") if c == text else F.col(f"_page._{i}")).alias(c) for i, c in enumerate(pages.columns) if c not in without]


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages with their boilerplate lines dropped, and the columns n_lines and n_removed."""
    out = _dropped(pages, host, text, ratio, least_pages)
    return out.select(*_columns(pages, text, ("n_lines", "n_removed")), F.col("_n").alias("n_lines"), F.col("_gone").alias("n_removed"))


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The columns of pages, with the boilerplate lines dropped from the text."""
    return _dropped(pages, host, text, ratio, least_pages).select(*_columns(pages, text))


ORACLE = f"""
WITH l AS (SELECT source, doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
n AS (SELECT source, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
b AS (SELECT n.source, list(line) AS gone FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
      WHERE c >= {LEAST_PAGES} AND c > {RATIO} * pages GROUP BY ALL),
k AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines,
      list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.gone, []), x)) AS kept
      FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_removed,
       array_to_string(kept, chr(10)) AS text FROM k
"""
