"""Tables in the folder that all executors share, which end the lineage of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = "file://" + tempfile.mkdtemp(prefix="quarrygraph-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_bases: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete what Rounds wrote; runs by itself when Python ends. Results that are read from it are gone then."""
    for spark, path in _bases:
        try:
            _delete(spark, path)
        except Exception:  # the session has gone; its folder goes with it
            pass
    _bases.clear()


atexit.register(release)


class Rounds:
    """Writes the state of each round of an iteration and deletes the one before the last. All of it goes with release()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", []
        _bases.append((spark, self.base))

    def there(self) -> bool:
        """Whether what it wrote hasn't been released."""
        return any(base == self.base for _, base in _bases)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2 and (old := self.paths[-3]):
            _delete(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def hold(self, df: DataFrame) -> DataFrame:
        """A table that stays."""
        path = f"{self.base}/held-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def split(self, df: DataFrame, by: str) -> tuple[DataFrame, set[int]]:
        """A table that stays, in one folder for each value of a column of whole numbers, so that filters on it prune files; and those values."""
        path = f"{self.base}/held-{uuid.uuid4().hex}"
        df.write.partitionBy(by).parquet(path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        return self.spark.read.schema(df.schema).parquet(path), {int(n.removeprefix(f"{by}=")) for n in names if n.startswith(f"{by}=")}
