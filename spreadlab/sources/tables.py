"""Scans and sinks for the raw, clean and study layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.functions.columns import col
from spreadlab.sources.contracts import PREDICTION_COLUMNS, SCHEMAS, require_columns

STUDY_INPUTS = ["rt_spp_transformed", "dam_spp_clean", "dam_system_lambda_clean",
                "load_forecast_clean", "wind_power_gen_clean", "solar_power_gen_clean"]


def scan_raw(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Header CSV scan under the declared schema of a dataset key."""
    if key not in SCHEMAS:
        raise KeyError(f"unknown dataset key {key!r}")
    return spark.read.schema(SCHEMAS[key]).csv(f"{root}/{key}", header=True)


def scan_study_inputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The six study inputs keyed by name without the layer suffix."""
    return {
        n.removesuffix("_clean").removesuffix("_transformed"): spark.read.parquet(f"{root}/{n}") for n in STUDY_INPUTS
    }


def scan_model_input(spark: SparkSession, root: str, point: str) -> DataFrame:
    """Final dataset of one settlement point (partition-pruned)."""
    loc, kind = point.rsplit("_", 1)
    return spark.read.parquet(root).where((F.col("location") == loc) & (F.col("location_type") == kind))


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), PREDICTION_COLUMNS, "predictions")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def safe_identifier(location: str | Column, kind: str | Column) -> Column:
    """`LOC_TYPE` with blanks and slashes as underscores and brackets removed."""
    raw = F.concat_ws("_", col(location), col(kind))
    return F.regexp_replace(F.regexp_replace(raw, "[ /]", "_"), "[()]", "")


def point_identifier(location: str | Column, kind: str | Column) -> Column:
    return F.concat(col(location), F.lit(" ("), col(kind), F.lit(")"))


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates collapse to one."""
    return df.dropDuplicates()


def write_layer(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("location",),
                span: str = "month", files_per_span: int = 1) -> None:
    """Partitioned sink: rows travel by (partition columns, calendar span), so one busy
    location is spread over many writers and files; files are sorted by time."""
    parts = [p for p in partition_by if p in df.columns]
    out = df.withColumn("__span", F.date_trunc(span, "utc_ts"))
    spread = [F.pmod(F.xxhash64("utc_ts"), F.lit(files_per_span))] if files_per_span > 1 else []
    out = out.repartition(*parts, "__span", *spread).sortWithinPartitions(*parts, "utc_ts").drop("__span")
    w = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*parts) if parts else w).save(path)


def write_daily(df: DataFrame, date_expr: Column, path: str, files_per_date: int = 4) -> None:
    """One directory per posted or delivery date; a date's rows go to a few writers, so files follow dates, not tasks."""
    dated = df.withColumn("extract_date", date_expr)
    dated.repartition("extract_date", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_date))).write.mode("overwrite").partitionBy("extract_date").parquet(path)
