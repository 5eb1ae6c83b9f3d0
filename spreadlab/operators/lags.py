"""History features of the target: lags and rolling statistics.

All of them cut the series into blocks with replicated edges (see blocks.py), so the
work of one location spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.operators.blocks import BLK, DAY, own_rows, row_numbers, time_block, with_halo

LAG_HOURS = [24, 25, 26, 27, 168]
ROLL_DAYS = [7, 14, 21]
KEYS = ["location", "location_type"]
ROWS_PER_BLOCK = 8192


def _by_rows(df: DataFrame, keys: list[str], order: str, back: int) -> DataFrame:
    numbered = row_numbers(df, keys, order, time_block(order), "__rn")
    return with_halo(numbered, F.col("__rn"), max(ROWS_PER_BLOCK, 4 * back), back)


def lag_rows(df: DataFrame, value: str, lags: list[int], keys: list[str] = KEYS, order: str = "utc_ts") -> DataFrame:
    """Value k rows earlier: rows, not hours, so gaps in the series shift it."""
    h = _by_rows(df, keys, order, max(lags))
    w = Window.partitionBy(*keys, BLK).orderBy("__rn")
    h = h.select("*", *[F.lag(value, k).over(w).alias(f"{value}_lag_{k}hr") for k in lags])
    return own_rows(h).drop("__rn")


def rolling_rows_shifted(df: DataFrame, value: str, windows: list[int], shift: int = 24,
                         keys: list[str] = KEYS, order: str = "utc_ts") -> DataFrame:
    """Mean and sample deviation over n rows that end `shift` rows earlier."""
    h = _by_rows(df, keys, order, shift + max(windows))
    w = Window.partitionBy(*keys, BLK).orderBy("__rn")
    cols = []
    for n in windows:
        f = w.rowsBetween(-(shift + n - 1), -shift)
        cols += [F.avg(value).over(f).alias(f"{value}_roll_mean_{n}hr"), F.stddev_samp(value).over(f).alias(f"{value}_roll_sdev_{n}hr")]
    return own_rows(h.select("*", *cols)).drop("__rn")


def history_features(df: DataFrame, value: str = "dart_slt", lags: list[int] = LAG_HOURS, rolls: list[int] = ROLL_DAYS,
                     keys: list[str] = KEYS, ts: str = "utc_ts", offset_hours: int = 24, block_days: int = 120) -> DataFrame:
    """Exact-time lags and same-hour daily statistics, sharing one exchange.

    Lag k reads the row at exactly t - (k + offset_hours); no such row gives null.
    Roll N covers the same hour on days 2..N+1 back: population deviation, null when
    any present value is null or when no row is present.
    """
    back = max([(k + offset_hours) * 3600 for k in lags] + [(n + 1) * DAY for n in rolls])
    sec = F.unix_seconds(ts)
    h = with_halo(df.withColumn("__sec", sec), F.col("__sec"), max(block_days * DAY, 2 * back), back)
    h = h.withColumn("__tod", F.pmod("__sec", F.lit(DAY)))
    by_time = Window.partitionBy(*keys, BLK).orderBy("__sec")
    same_hour = Window.partitionBy(*keys, BLK, "__tod").orderBy("__sec")
    cols = []
    for k in lags:
        d = (k + offset_hours) * 3600
        cols.append(F.max(value).over(by_time.rangeBetween(-d, -d)).alias(f"{value}_lag_{k}hr"))
    for n in rolls:
        f = same_hour.rangeBetween(-(n + 1) * DAY, -2 * DAY)
        full = F.count(F.lit(1)).over(f) == F.count(value).over(f)
        cols.append(F.when(full, F.avg(value).over(f)).alias(f"{value}_roll_mean_{n * 24}hr"))
        cols.append(F.when(full, F.stddev_pop(value).over(f)).alias(f"{value}_roll_sdev_{n * 24}hr"))
    return own_rows(h.select("*", *cols)).drop("__sec", "__tod")


def leakage_audit(df: DataFrame, ts: str = "utc_ts", lags: list[int] = LAG_HOURS, rolls: list[int] = ROLL_DAYS,
                  offset_hours: int = 24) -> DataFrame:
    """Per row: information cutoff (delivery date - 2 days, 23:00) against the newest source instant used.

    Only the calendar-day features are bound by the cutoff; exact lags are reported beside them.
    """
    day = F.date_trunc("day", ts)
    newest_lag = min(lags) + offset_hours
    return df.select(
        *[c for c in KEYS if c in df.columns], ts,
        (day - F.expr("INTERVAL 2 DAYS") + F.expr("INTERVAL 23 HOURS")).alias("cutoff_ts"),
        (F.col(ts) - F.expr("INTERVAL 2 DAYS")).alias("newest_roll_source"),
        (F.col(ts) - F.make_dt_interval(hours=F.lit(newest_lag))).alias("newest_lag_source"),
    ).withColumn("within_cutoff", (F.col("newest_roll_source") <= F.col("cutoff_ts")) & (F.col("newest_lag_source") <= F.col("cutoff_ts")))
