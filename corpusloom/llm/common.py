"""What the operators of this subpackage share: tables, shared files and column hygiene."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import read_table

#: Used only where the cluster names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/corpusloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, over all cores where its files have fewer splits than that."""
    return read_table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local folder serves a local
    master; on a cluster it would be another one on each machine, so there it is an error."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named and not re.match(r"local($|\[)", conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")

#: Rows of a part of a scratch table whose rows are a few numbers.
PART_ROWS = 1 << 16


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor costs a re-read, not a recomputation.

    What is not dropped before goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, most: int | None = None) -> DataFrame:
        """most: a bound on the rows, for tables of a few numbers a row. Small ones are then dealt to few parts before they are
        written, however many partitions a shuffle has: each part is a file to make, to list and to open, and local file
        systems start a process for each."""
        if most is not None:
            parts = max(self.spark.sparkContext.defaultParallelism, -(-most // PART_ROWS))
            if parts < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.repartition(parts)
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        if self.n == 1:
            root, fs = self._at(self.root)
            fs.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now: it does so once the driver has collected its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table put earlier; the caller no longer reads it."""
        path = self.paths.pop(id(df), None)
        if path:
            at, fs = self._at(path)
            fs.delete(at, True)

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose names an operator is about to add, whatever their letter case."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])
