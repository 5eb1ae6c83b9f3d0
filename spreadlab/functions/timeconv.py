"""Market time: hour-ending labels, local clock to UTC, interval offsets, spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import col

MARKET_TZ = "America/Chicago"


def hour_ending_to_start(c: str | Column) -> Column:
    """"HH:MM" label to start hour; text without a colon gives null."""
    x = col(c)
    return F.when(x.contains(":"), F.try_element_at(F.split(x, ":"), F.lit(1)).try_cast("int") - 1)


def delivery_hour_to_start(c: str | Column) -> Column:
    """Integer delivery hour 1..24 to start hour 0..23; anything else fails the job."""
    x = col(c).cast("int")
    return F.when(x.between(1, 24), x - 1).when(
        x.isNotNull(), F.raise_error(F.concat(F.lit("delivery hour out of range: "), x.cast("string"))).cast("int")
    )


def local_to_utc(local: str | Column, start_hour: str | Column, dst_flag: str | Column,
                 tz: str = MARKET_TZ) -> Column:
    """Local wall clock to UTC.

    In the repeated autumn hour (start hour 1) a true flag means the second pass,
    i.e. standard time. A time inside the spring gap moves to the first valid instant.
    """
    local, hour, flag = col(local), col(start_hour), col(dst_flag)
    first = F.to_utc_timestamp(local, tz)
    hour_later = first + F.expr("INTERVAL 1 HOUR")
    repeated = F.from_utc_timestamp(hour_later, tz) == local
    in_gap = F.from_utc_timestamp(first, tz) != local
    return (
        F.when(in_gap, F.date_trunc("hour", first))
        .when((hour == 1) & repeated & F.coalesce(flag, F.lit(False)), hour_later)
        .otherwise(first)
    )


def utc_to_local(c: str | Column, tz: str = MARKET_TZ) -> Column:
    return F.from_utc_timestamp(col(c), tz)


def shift_seconds(ts: str | Column, seconds: Column | int) -> Column:
    """Add seconds to an instant without calendar arithmetic."""
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(col(ts)) + s.cast("bigint") * 1000000)


def add_minutes(ts: str | Column, minutes: Column) -> Column:
    return col(ts) + F.make_dt_interval(mins=minutes.cast("int"))


def with_utc(df: DataFrame, date_col: str = "deliveryDate", start_hour: str | Column = "start_hour",
             dst_flag: str = "DSTFlag", minutes: Column | None = None) -> DataFrame:
    """Delivery date + start hour (+ minutes before localising) to local_ts and utc_ts."""
    base = F.col(date_col).cast("timestamp") + F.make_dt_interval(
        hours=col(start_hour).cast("int"), mins=(minutes if minutes is not None else F.lit(0)).cast("int")
    )
    return df.withColumn("local_ts", base).withColumn(
        "utc_ts", local_to_utc("local_ts", start_hour, dst_flag)
    )


def with_interval_offset(df: DataFrame, interval_col: str = "deliveryInterval") -> DataFrame:
    """Quarter-hour offset added to both clocks after localising; no-op without the column."""
    if interval_col not in df.columns:
        return df
    mins = (F.col(interval_col).cast("int") - 1) * 15
    return df.withColumn("utc_ts", add_minutes("utc_ts", mins)).withColumn(
        "local_ts", add_minutes("local_ts", mins)
    )


def date_spine(bounds: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """One row per calendar day between two date columns of a small bounds table."""
    return bounds.select(F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias(out))


def posting_window(posted: str | Column, hour: int = 6, minute: int = 0, hours_before: int = 1) -> Column:
    """True inside [hour - hours_before, hour] o'clock of the posting day; the lower edge stops at 00."""
    p = col(posted)
    day = F.date_trunc("day", p)
    lo = day + F.make_dt_interval(hours=F.lit(max(hour - hours_before, 0)), mins=F.lit(minute))
    hi = day + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    return (p >= lo) & (p <= hi)
