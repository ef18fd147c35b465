"""Sessions for this library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results or plans depend on; sizes of partitions and memory are the cluster's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "trustmill", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Only a session on one machine that has no
    such folder is given one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="trustmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder}/trustmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once and the same for all who read it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the larger side that one task of a join sorts.
TASK_ROWS = 500_000


def dealt(larger: DataFrame, smaller: DataFrame, key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on a key, dealt to as many tasks as its rows ask for and merged in order: what a task holds does
    not grow with the tables, and no side is sent whole to every executor. rows: those of the larger side."""
    n = max(larger.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return larger.repartition(n, key), smaller.repartition(n, key).hint("merge")


def clear(spark: SparkSession) -> None:
    """Removes all that this application has stored; results that were not written elsewhere are gone with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "x").rsplit("/", 1)[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
