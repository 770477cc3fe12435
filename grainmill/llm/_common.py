"""What the operators share: input tables, tables in the shared folder, code on the executors, size checks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import shipping

#: Rows of an Arrow batch, at most: texts are long, and a batch is in memory on both sides.
BATCH_ROWS = 2000

#: A side of a join is broadcast only up to so many bytes, as counted from its rows; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """The code to the executors, and the session's Arrow batches to BATCH_ROWS rows, unless they are smaller."""
    shipping.ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or under an own folder where that is unset.

    Raises RuntimeError where it is unset and executors are on other machines: what they wrote there would be missed silently.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="grainmill-"))
        base = sc.getCheckpointDir()
    folder = f"{base.rstrip('/')}/grainmill-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


class Workspace:
    """Tables of one run in the shared folder. stored() cuts the lineage, and survives a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0
        self.paths: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n:03d}-{name}"

    def stored(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = self.path(name)
        self.paths.setdefault(name, []).append(path)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, *names: str) -> None:
        """Delete the tables stored under these names so far, which nothing will read again, and tidy()."""
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tidy()

    def tidy(self) -> None:
        """Have the driver drop what it no longer refers to, shuffle files on the executors among it."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def words_of(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's bytes, to size partitions by; where it has none, 16 MB for each shuffle partition."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else (16 << 20) * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
