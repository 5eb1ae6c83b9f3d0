"""Cleaning: filters, standard projections, zone reshapes and validators.

Validators return tables of findings instead of raising, so they can be joined,
stored or asserted on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import no_nan
from spreadlab.sources.contracts import POINT_PREFIXES


def keep_prefixes(df: DataFrame, column: str, prefixes: list[str] = POINT_PREFIXES) -> DataFrame:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col(column).startswith(p)
    return df.where(cond)


def keep_flagged(df: DataFrame, flag: str = "inUseFlag") -> DataFrame:
    """Rows whose flag is true; null counts as false."""
    return df.where(F.col(flag))


def keep_points(df: DataFrame, column: str, points: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(points))


def keep_delivery_day(df: DataFrame, start: str, end: str, point: str | None = None) -> DataFrame:
    out = df.where(F.col("deliveryDate").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out if point is None else out.where(F.col("settlementPoint") == point)


def clean_rt(raw: DataFrame) -> DataFrame:
    return keep_prefixes(raw, "settlementPoint").select(
        "utc_ts", "local_ts", F.col("settlementPoint").alias("location"),
        F.col("settlementPointType").alias("location_type"), "deliveryHour", "deliveryInterval",
        F.col("settlementPointPrice").alias("price"), F.col("DSTFlag").alias("dst_flag"),
    )


def clean_dam(raw: DataFrame) -> DataFrame:
    return keep_prefixes(raw, "settlementPoint").select(
        "utc_ts", "local_ts", F.col("settlementPoint").alias("location"),
        F.col("settlementPointPrice").alias("price"), F.col("DSTFlag").alias("dst_flag"),
    )


def clean_lambda(raw: DataFrame) -> DataFrame:
    return raw.select("utc_ts", "local_ts", F.col("systemLambda").alias("price"), F.col("DSTFlag").alias("dst_flag"))


def melt_zones(df: DataFrame, ids: list[str], zones: list[str], value: str) -> DataFrame:
    """Zone columns to (location, value) rows."""
    typed = df.select(*ids, *[F.col(z).cast("double").alias(z) for z in zones])
    return typed.unpivot(ids, zones, "location", value)


def clean_forecast(raw: DataFrame, zones: list[str], value: str, *, in_use_only: bool = False,
                   drop_null_values: bool = True) -> DataFrame:
    """Posted forecast report to long form. Wind and solar drop unusable values, load keeps them."""
    src = keep_flagged(raw) if in_use_only else raw
    src = src.withColumnsRenamed({"postedDatetime": "posted_datetime", "DSTFlag": "dst_flag"})
    out = melt_zones(src, ["posted_datetime", "utc_ts", "local_ts", "dst_flag"], zones, value)
    return coerce_and_drop(out, value) if drop_null_values else out


def coerce_and_drop(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.withColumn(value, no_nan(v.try_cast("double"))).where(F.col(value).isNotNull())


def distinct_dates(df: DataFrame, ts: str, out: str = "posted_date") -> DataFrame:
    return df.select(F.to_date(ts).alias(out)).distinct()


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null) in long form from one aggregation."""
    wide = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot(["__n"], df.columns, "column_name", "n_null").select(
        "column_name", F.col("__n").alias("n_rows"), "n_null"
    )


# Columns every normalised table should carry.
CANONICAL_COLUMNS = ["utc_ts", "local_ts", "hour_local"]


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, canonical columns absent, cells that are null."""
    absent = [c for c in CANONICAL_COLUMNS if c not in df.columns]
    nulls = F.lit(0)
    for c in df.columns:
        nulls = nulls + F.count_if(F.col(c).isNull())
    return df.agg(F.count("*").alias("n_rows"), nulls.cast("long").alias("n_null_cells")).withColumns({
        "n_columns": F.lit(len(df.columns)), "missing_columns": F.lit(",".join(absent))})


def with_hour_local(df: DataFrame, local: str = "local_ts") -> DataFrame:
    return df.withColumn("hour_local", F.hour(local))


def validate_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return null_profile(df.select(*columns)).withColumn("passed", F.col("n_null") == 0)


def validate_domain(df: DataFrame, column: str, *, prefixes: list[str] | None = None,
                    members: list[str] | None = None) -> DataFrame:
    """Offending values with their row counts; empty when the domain holds."""
    ok: Column = F.lit(False)
    for p in prefixes or []:
        ok = ok | F.col(column).startswith(p)
    if members:
        ok = ok | F.col(column).isin(members)
    return df.where(~ok).groupBy(F.col(column).alias("offender")).agg(F.count("*").alias("n_rows"))


def validate_nonempty(df: DataFrame, column: str = "location_type") -> DataFrame:
    n_blank = F.count_if(F.col(column).isNull() | (F.trim(F.col(column)) == ""))
    return df.agg(F.count("*").alias("n_rows"), n_blank.alias("n_blank")).withColumn(
        "passed", (F.col("n_rows") > 0) & (F.col("n_blank") == 0)
    )


def incomplete_days(df: DataFrame, by: list[str] | None = None, ts: str = "utc_ts", hours: int = 24) -> DataFrame:
    """Calendar days of each series with fewer than 24 distinct hours, absent days included.

    The first and last day may be partial; `interior` marks the days that fail the check.
    """
    by = by or []
    keyed = df if by else df.withColumn("__all", F.lit(1))
    keys = by or ["__all"]
    per_day = (
        keyed.groupBy(*keys, F.to_date(ts).alias("day"), F.hour(ts).alias("__h")).agg(F.lit(1).alias("__one"))
        .groupBy(*keys, "day").agg(F.count("*").alias("hours_present"))
    )
    span = per_day.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    days = span.withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    out = days.join(per_day, [*keys, "day"], "left").select(
        *by, "day", F.coalesce("hours_present", F.lit(0)).cast("long").alias("hours_present"),
        ((F.col("day") > F.col("first_day")) & (F.col("day") < F.col("last_day"))).alias("interior"),
    )
    return out.where(F.col("hours_present") < hours)


def completeness(df: DataFrame, by: list[str] | None = None, ts: str = "utc_ts") -> DataFrame:
    """Per series: days present, calendar span, incomplete interior days, verdict."""
    by = by or []
    keys = by or ["__all"]
    keyed = df if by else df.withColumn("__all", F.lit(1))
    base = keyed.groupBy(*keys).agg(
        F.min(F.to_date(ts)).alias("first_day"), F.max(F.to_date(ts)).alias("last_day")
    )
    gaps = incomplete_days(keyed, keys, ts).groupBy(*keys).agg(
        F.count("*").alias("n_short_days"), F.count_if("interior").alias("n_short_interior"),
        F.count_if(F.col("hours_present") == 0).alias("n_absent_days"),
    )
    j = base.join(gaps, keys, "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select(
        *by, (F.datediff("last_day", "first_day") + 1).cast("long").alias("span_days"),
        z("n_absent_days"), z("n_short_days"), z("n_short_interior"),
    ).withColumn("complete", F.col("n_short_interior") == 0)


def late_nulls(df: DataFrame, by: list[str], target: str, ts: str = "utc_ts") -> DataFrame:
    """Per series: rows with a null target, and how many fall a day or more after its start."""
    first = df.groupBy(*by).agg(F.min(F.to_date(ts)).alias("__first"))
    nulls = df.where(F.col(target).isNull()).groupBy(*by, F.to_date(ts).alias("__d")).agg(F.count("*").alias("__n"))
    j = first.join(nulls, by, "left")
    return j.groupBy(*by).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n_null"),
        F.coalesce(F.sum(F.when(F.datediff("__d", "__first") >= 1, F.col("__n"))), F.lit(0)).cast("long").alias("n_late_null"),
    )
