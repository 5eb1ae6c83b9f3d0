"""Forecast vintages: newest report admissible before delivery, spread into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import signed_log


def admissible(df: DataFrame, posted: str = "posted_datetime", ts: str = "utc_ts", days_before: int = 1) -> DataFrame:
    """Reports posted no later than `days_before` days before the delivery date (UTC dates)."""
    return df.where(F.to_date(posted) <= F.date_sub(F.to_date(ts), days_before))


def _rank(posted: str, tie: str | None) -> Column:
    return F.struct(F.col(posted), -F.col(tie)) if tie else F.struct(F.col(posted))


def latest_vintage(df: DataFrame, value: str, keys: tuple[str, ...] = ("utc_ts", "location"), posted: str = "posted_datetime",
                   tie: str | None = None, days_before: int = 1) -> DataFrame:
    """Newest admissible report per key; the lowest `tie` wins among equal posting times.

    An aggregate, so vintages combine map-side and a hot key costs one buffer.
    """
    best = F.max_by(F.struct(F.col(posted), F.col(value)), _rank(posted, tie)).alias("__best")
    return admissible(df, posted, days_before=days_before).groupBy(*keys).agg(best).select(
        *keys, F.col(f"__best.{posted}").alias(posted), F.col(f"__best.{value}").alias(value))


def vintage_wide(df: DataFrame, value: str, zones: list[str], prefix: str, ts: str = "utc_ts", zone: str = "location",
                 posted: str = "posted_datetime", tie: str | None = None, days_before: int = 1) -> DataFrame:
    """Pick and pivot in one shuffle: a column per zone holding its newest admissible value."""
    aggs = []
    for z in zones:
        here = F.col(zone) == z
        aggs.append(F.max_by(F.when(here, F.col(value)), F.when(here, _rank(posted, tie))).alias(f"{prefix}{z}"))
    return admissible(df, posted, ts, days_before).groupBy(ts).agg(*aggs)


def with_slt(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_slt": signed_log(c) for c in columns})


def forecast_features(study: DataFrame, forecast: DataFrame, value: str, zones: list[str], prefix: str,
                      tie: str | None = None, ts: str = "utc_ts") -> DataFrame:
    """Pick, pivot, left join on the delivery hour, signed-log copies."""
    wide = vintage_wide(forecast, value, zones, prefix, ts, tie=tie)
    return with_slt(study.join(wide, ts, "left"), [f"{prefix}{z}" for z in zones])


def join_audit(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Per joined column: rows, nulls, null share, min, max, mean, all-null flag."""
    n = F.count("*")
    packed = [
        F.struct(F.lit(c).alias("column_name"), n.alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"),
                 F.min(c).cast("double").alias("min_value"), F.max(c).cast("double").alias("max_value"),
                 F.avg(c).alias("mean_value")) for c in columns
    ]
    out = joined.agg(F.array(*packed).alias("a")).select(F.inline("a"))
    return out.withColumn("null_share", F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows"))).withColumn(
        "all_null", F.col("n_null") == F.col("n_rows"))
