"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key that holds a third of the rows is split at run time, even when the
    # operator above the join would otherwise reuse the join's partitioning.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that was built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearby_engine")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path inside the shared folder; never one that is already in use."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def landed(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder: what reads it takes only the columns it needs, as often as it likes."""
    path = fresh_folder(df.sparkSession, "landed")
    # Ids are hexadecimal digests, which only a coder of entropy makes smaller.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` dealt over tasks by the hash of ``keys``, before costly rows are made of narrow ones.

    A narrow table is read by as few tasks as it has row groups, however much is made of a row. The number of parts is given,
    because the run-time planner would join parts by their bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, bucketed and sorted by ``key``: joins on the key do not shuffle it, however
    often it is joined. The table's name is gone afterwards, its files stay until the shared folder is cleared."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    count = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartition(count, key)
    dealt.write.bucketBy(count, key).sortBy(key).option("path", fresh_folder(spark, "bucketed")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
