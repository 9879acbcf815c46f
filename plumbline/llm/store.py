"""Intermediate tables in the folder that all executors share, and small session helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows handed to a Python worker at once. Texts may be long, so batches are kept short; workers slice them further by bytes.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset (local tests) one is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


class Scratch:
    """Tables written in the shared folder. drop() deletes one; what a returned frame still reads has to stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.paths = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        # snappy, as zstd holds native memory beside the heap for every writer until the garbage collector comes by
        df.write.option("compression", "snappy").parquet(path)
        self.paths[name] = path
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Shuffle files of finished steps go when the driver has collected its garbage; ask for that now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Plans made inside hand Python at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
