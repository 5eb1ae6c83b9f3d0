"""Session settings the library relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "spreadlab", cores: str | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Market time arithmetic is defined on a UTC session clock."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local session may lack it."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "/tmp/checkpoints"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared checkpoint folder and read it from there.

    For results that several later steps read; a lost executor re-reads files instead of
    recomputing the whole chain.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write rows once as Parquet in the shared checkpoint folder and read them from there; the folder goes with the session."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


BROADCAST_BYTES = 16 << 20


def bytes_of(table: DataFrame) -> int:
    """Size of a table's rows as text, summed where they are."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0


def join_measured(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join rows to a table with one row per group, broadcasting it only after measuring it.

    The planner sizes an aggregate by its input and would shuffle all rows by group, hot
    groups included. The group table is computed once, its bytes are summed, and it is
    broadcast when they are few; beyond the limit the join stays a shuffle join.
    """
    table = materialise(small)
    fits = bytes_of(table) <= max_bytes
    return df.join(F.broadcast(table) if fits else table, keys, how)
