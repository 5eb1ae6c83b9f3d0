"""Descriptive statistics per series: distributions, boxes, Q-Q fits, ECDF, seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import col, normal_ppf, ratio
from spreadlab.operators.quantiles import exact_quantiles, order_positions, with_quantiles
from spreadlab.session import join_measured

POINT = ["location", "location_type"]
# Percentiles reported for a distribution.
DISTRIBUTION_PROBS = {"p67": 0.67, "p90": 0.90, "p95": 0.95, "p99": 0.99}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def long_form(df: DataFrame, keys: list[str], columns: dict[str, Column | str], name: str = "feature", value: str = "value") -> DataFrame:
    """Columns to (name, value) rows; `columns` maps label to expression."""
    wide = df.select(*keys, *[col(c).cast("double").alias(label) for label, c in columns.items()])
    return wide.unpivot(keys, list(columns), name, value)


def split_by_sign(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positive and |negative| values side by side; zeros and nulls drop out."""
    v = F.col(value)
    return df.where((v > 0) | (v < 0)).select(
        *keys, F.when(v > 0, "positive").otherwise("negative").alias("sign"), F.abs(v).alias("value"))


def distribution_stats(df: DataFrame, keys: list[str], value: str = "value", min_rows: int = 1) -> DataFrame:
    """Count, mean, population deviation, percentiles, min, max."""
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max")).where(F.col("n") >= min_rows)
    return with_quantiles(base, exact_quantiles(df, keys, value, DISTRIBUTION_PROBS), keys)


def box_stats(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Five-number summary with mean, sample deviation and interquartile range."""
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return with_quantiles(base, exact_quantiles(df, keys, value, QUARTILES), keys).withColumn("iqr", F.col("q3") - F.col("q1"))


def plotting_position(i: Column, n: Column) -> Column:
    """Filliben's median estimate of the i-th of n order statistics."""
    n = n.cast("double")
    top = F.pow(F.lit(0.5), 1.0 / n)
    return F.when(i == n, top).when(i == 1, 1.0 - top).otherwise((i - 0.3175) / (n + 0.365))


def qq_points(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sorted values beside the normal quantiles of their plotting positions."""
    return order_positions(df, keys, value).withColumn(
        "normal_quantile", normal_ppf(plotting_position(F.col("position"), F.col("total"))))


def qq_fit(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Least-squares line through the normal Q-Q points."""
    return qq_points(df, keys, value).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("value", "normal_quantile").alias("slope"),
        F.regr_intercept("value", "normal_quantile").alias("intercept"),
        F.corr("value", "normal_quantile").alias("r"),
    ).withColumn("r_squared", F.col("r") * F.col("r"))


def ecdf(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return order_positions(df, keys, value).select(
        *keys, "value", F.col("position").alias("cum_count"), (F.col("position") / F.col("total")).alias("cum_prob"))


def ecdf_stats(signed: DataFrame, keys: list[str], totals: DataFrame, min_rows: int = 5) -> DataFrame:
    """Size, share of all rows, range and quartiles of each sign."""
    by = [*keys, "sign"]
    base = signed.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max")).where(F.col("n") >= min_rows)
    base = base.join(totals, keys).withColumn("proportion", ratio("n", "n_total")).drop("n_total")
    return with_quantiles(base, exact_quantiles(signed, by, "value", QUARTILES), by)


def signed_slot_stats(df: DataFrame, keys: list[str], value: str, slot: str, slots: list[int]) -> DataFrame:
    """Mean, sample deviation and count of positive and |negative| values per slot; empty slots present."""
    pos, neg = F.when(F.col(value) > 0, F.col(value)), F.when(F.col(value) < 0, -F.col(value))
    stats = df.groupBy(*keys, slot).agg(
        F.avg(pos).alias("positive_mean"), F.stddev_samp(pos).alias("positive_std"), F.count(pos).alias("positive_count"),
        F.avg(neg).alias("negative_mean_abs"), F.stddev_samp(neg).alias("negative_std_abs"), F.count(neg).alias("negative_count"))
    return fill_slots(stats, keys, slot, slots, ["positive_count", "negative_count"])


def fill_slots(stats: DataFrame, keys: list[str], slot: str, slots: list[int], zero: list[str]) -> DataFrame:
    """Complete an aggregated table to every slot of a small fixed domain."""
    spine = stats.select(*keys).distinct().withColumn(slot, F.explode(F.array(*[F.lit(s) for s in slots])))
    return spine.join(stats, [*keys, slot], "left").na.fill(0, zero)


def sign_heatmap(df: DataFrame, keys: list[str], value: str = "dart_slt", hour: str = "end_of_hour", weekday: str = "day_of_week") -> DataFrame:
    pos = F.count_if(F.col(value) > 0)
    out = df.where(F.col(value).isNotNull()).groupBy(*keys, hour, weekday).agg(
        F.count(value).alias("sample_count"), pos.alias("positive_count"))
    rate = F.col("positive_count") / F.col("sample_count")
    return out.withColumns({"negative_count": F.col("sample_count") - F.col("positive_count"), "positivity_rate": rate, "negative_rate": 1 - rate})


def spread_heatmap(df: DataFrame, keys: list[str], value: str = "dart", hour: str = "end_of_hour", weekday: str = "day_of_week") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, hour, weekday).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def heatmap_pivot(heat: DataFrame, keys: list[str], value: str, hour: str = "end_of_hour", weekday: str = "day_of_week") -> DataFrame:
    """24 x 7 grid with every hour present."""
    grid = heat.groupBy(*keys, hour).pivot(weekday, list(range(7))).agg(F.first(value))
    grid = grid.select(*keys, hour, *[F.col(str(d)).alias(f"dow_{d}") for d in range(7)])
    return fill_slots(grid, keys, hour, list(range(1, 25)), [])


def histogram(df: DataFrame, keys: list[str], value: str = "value", bins: int = 80) -> DataFrame:
    """Equal-width histogram between the group's own min and max."""
    rng = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.when(width > 0, F.floor((F.col(value) - F.col("lo")) / width)).otherwise(0)
    binned = join_measured(df.where(F.col(value).isNotNull()), rng, keys).withColumn("bin", F.least(raw.cast("int"), F.lit(bins - 1)))
    return binned.groupBy(*keys, "bin", "lo", "hi").agg(F.count("*").alias("n")).select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "n")


def threshold_to_zero(c: str | Column, floor: float = 1.0) -> Column:
    """Values under the floor count as zero (night-time solar output)."""
    x = col(c)
    return F.when(x >= floor, x).when(x.isNotNull(), F.lit(0.0))


def distribution_summary(df: DataFrame, keys: list[str], value: str = "value", ignore_zeros: Column | None = None) -> DataFrame:
    """Row counts, mean, sample deviation and Q-Q fit; zeros optionally left out first."""
    v = F.col(value)
    kept = v if ignore_zeros is None else F.when(~(ignore_zeros & (v == 0)), v)
    d = df.withColumn("__kept", kept)
    base = d.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count(v).alias("n_present"), F.count_if(v == 0).alias("n_zero"), F.count("__kept").alias("n_used"),
        F.avg("__kept").alias("mean"), F.stddev_samp("__kept").alias("std"))
    return base.join(qq_fit(d, keys, "__kept").select(*keys, "r_squared"), keys, "left")
