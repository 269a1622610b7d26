"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import logloom


def builder(app: str = "logloom") -> SparkSession.Builder:
    """Session builder with the settings that have to be there from the start."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        # Otherwise every column call looks up its call site, which slows down wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the expressions of this package rely on; all are runtime settings."""
    # The few Python functions travel with their tasks: workers need no installed package.
    cloudpickle.register_pickle_by_value(logloom)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # Methods above this bytecode size are never compiled by the JVM: wide projections run
    # several times faster as many small methods than as one that stays interpreted.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Hot keys of a join are split even where that costs another shuffle behind it.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so that it is neither recomputed nor lost."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of tables that nothing refers to any more.

    Its cleaner only learns of them when the driver's JVM collects garbage, which a long loop of small jobs may not
    make it do before the disks are full. Call it between rounds, after the last reference to a table is gone.
    """
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table that is written and read again."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as compressed columns in the shared folder: far fewer bytes than ``durable`` takes for many rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
