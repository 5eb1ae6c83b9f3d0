"""What the corpus operators share: the word pattern, whitespace removal and tables in the shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def without_blanks(text: Column) -> Column:
    """Text without any of the six blank characters; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


#: Ids from here on stand for rows without an id, one for each text; real ids are smaller.
NO_ID = 1 << 62


def row_ids(id_: Column, text: Column) -> Column:
    """The id of a row; without one, a number beyond all ids that follows from its text."""
    return F.coalesce(id_.cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(NO_ID))


def real_id(oid: Column) -> Column:
    return F.when(oid < NO_ID, oid)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session may lack it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints"


class Scratch:
    """Intermediate tables in the shared folder: written once as Parquet, read by later steps.

    A lost executor re-reads files instead of recomputing the chain before them. `drop`
    removes a table that no unfinished step reads any more; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        self.release()
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        self.paths[name] = path
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of steps that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
