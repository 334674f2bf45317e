"""Keeping a graph up to date: micro-batches of changed files replace what those files gave before.

The reference of such a graph is a batch one; this is the natural extension, a stream of files whose
batches go through the same readers. A batch is idempotent: it overwrites the partitions of its own files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def refresh(files: DataFrame, read: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """files is a stream of (path, kind, text); read gives fact rows with the path they come from, which are
    kept in table by a hash of the path, so that a batch rewrites only the buckets it touches."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        facts = read(df.dropDuplicates(["path"])).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(64)).cast("int"))
        try:
            old = spark.read.parquet(table)
        except Exception:  # the first batch
            old = None
        touched = facts.select("bucket").distinct()
        if old is not None:
            kept = old.join(touched, "bucket", "left_semi").join(df.select("path").distinct(), "path", "left_anti")
            facts = facts.unionByName(kept.select(facts.columns))
        staging = f"{table}.staging"
        facts.write.mode("overwrite").parquet(staging)
        spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
