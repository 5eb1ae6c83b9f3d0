"""Input files through the cluster's file system: listing, the exactly-one rule, broken records, and moves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.session import checkpoint_dir
from spreadlab.sources.contracts import SCHEMAS
from spreadlab.sources.tables import STUDY_INPUTS

CORRUPT = "_corrupt_record"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the session."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = _at(spark, path)
    fs.deleteOnExit(where)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    where, fs = _at(spark, old)
    if not fs.rename(where, _at(spark, new)[0]):
        raise OSError(f"cannot rename {old} to {new}")


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted; hidden ones are left out."""
    where, fs = _at(spark, pattern)
    found = fs.globStatus(where) or []
    names = sorted(s.getPath().toString() for s in found)
    return [n for n in names if n.rsplit("/", 1)[1][:1] not in "._"]


def the_one(spark: SparkSession, pattern: str) -> str:
    """The single path that matches; none or several fail."""
    found = list_files(spark, pattern)
    if len(found) != 1:
        raise FileNotFoundError(f"{pattern} matches {len(found)} paths, one is wanted: {found[:5]}")
    return found[0]


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV under a declared schema, with the file of each row and the text of records that do not fit it.

    Columns: those of the schema, _corrupt_record (null for sound records), source_file. A
    missing path fails.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"))


def sound(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "source_file")


def record_counts(rows: DataFrame) -> DataFrame:
    """Records, broken records and cells with a value, per file.

    All columns are read: Spark finds a record broken by the columns that a query asks for.
    """
    name = F.element_at(F.split("source_file", "/"), -1)
    cells = F.lit(0)
    for c in rows.columns:
        if c not in (CORRUPT, "source_file"):
            cells = cells + F.col(c).isNotNull().cast("int")
    return rows.groupBy(name.alias("file")).agg(F.count("*").alias("n_records"), F.count_if(F.col(CORRUPT).isNotNull()).alias("n_broken"), F.sum(cells).alias("n_values"))


def scan_dataset(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The one folder or file of a dataset key under its declared schema."""
    if key not in SCHEMAS:
        raise KeyError(f"unknown dataset key {key!r}")
    return scan_csv(spark, the_one(spark, f"{root}/{key}*"), SCHEMAS[key])


def scan_study(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The six study inputs by name; each has to stand there exactly once."""
    short = lambda n: n.removesuffix("_clean").removesuffix("_transformed")
    return {short(n): spark.read.parquet(the_one(spark, f"{root}/{n}*")) for n in STUDY_INPUTS}


def scan_point(spark: SparkSession, root: str, point: str) -> DataFrame:
    """The final dataset of one settlement point, from the one folder that has its name."""
    return spark.read.parquet(the_one(spark, f"{root}/*{point}*"))
