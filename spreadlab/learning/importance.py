"""Feature importance tables and cross-hour comparisons.

Inputs hold one row per (week, hour, feature): their size follows models and features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import rnd

# Importance categories by name fragment; the first match wins.
CATEGORY_RULES = [
    ("temporal", ["hour", "dow", "doy", "month", "week", "holiday", "weekend"]), ("load_forecast", ["load"]), ("wind_forecast", ["wind"]),
    ("solar_forecast", ["solar"]), ("dart_historical", ["dart"]),
]
# Selection categories by name fragment; a feature counts once, in the first that matches.
SELECTION_RULES = [
    ("lag_features", ["lag_"]), ("rolling_features", ["roll_"]), ("load_features", ["load_forecast_"]), ("wind_features", ["wind_generation_"]),
    ("solar_features", ["solar_"]), ("time_features", ["is_weekend", "is_holiday", "day_of_week_"]),
]


def category(name: Column, rules=CATEGORY_RULES) -> Column:
    low, out = F.lower(name), F.lit("other")
    for label, parts in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, label).otherwise(out)
    return out


def importance_long(models: DataFrame, keys: list[str], names: list[str], values: str) -> DataFrame:
    """Array of importances per model to (keys, feature, importance) rows."""
    labels = F.array(*[F.lit(n) for n in names])
    return models.select(*keys, F.posexplode(values).alias("__i", "importance")).select(*keys, labels[F.col("__i")].alias("feature"), "importance")


def selection_by_category(coefs: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    kept = coefs.where(F.abs("coefficient") > eps)
    return kept.groupBy(*keys, category(F.col("feature"), SELECTION_RULES).alias("category")).agg(F.count("*").alias("n_selected"))


def feature_summary(imp: DataFrame, keys: list[str] = [], value: str = "importance") -> DataFrame:
    v = F.col(value)
    return imp.groupBy(*keys, "feature").agg(
        rnd(F.avg(v)).alias("mean"), rnd(F.stddev_samp(v)).alias("std"), F.count(v).alias("n"), rnd(F.avg(F.abs(v))).alias("abs_mean"),
        rnd(F.max(F.abs(v))).alias("abs_max"), F.count_if(v == 0).alias("n_zero"))


def weekly_feature_summary(imp: DataFrame) -> DataFrame:
    v = F.col("importance")
    return imp.groupBy("week_num", "feature").agg(
        F.avg(v).alias("mean_importance"), F.max(v).alias("max_importance"), F.min(v).alias("min_importance"), F.stddev_pop(v).alias("std_importance"),
        F.count_if(v > 0).alias("hours_nonzero"), F.count("*").alias("hours_total"), (100.0 * F.count_if(v > 0) / F.count("*")).alias("pct_hours_used"))


def ranked(imp: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """Zero-based rank of the strongest features per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc_nulls_last(), "feature")
    return imp.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < top)


def importance_by_category(imp: DataFrame, keys: list[str]) -> DataFrame:
    return imp.groupBy(*keys, category(F.col("feature")).alias("category")).agg(F.sum("importance").alias("importance"), F.count("*").alias("n_features"))


def _with_hour_count(top: DataFrame, hour: str) -> DataFrame:
    """Number of distinct hours beside every row of a top list (a few hundred rows)."""
    return top.withColumn("__h", F.size(F.collect_set(hour).over(Window.partitionBy(F.lit(1)))))


def consistent_features(top: DataFrame, hour: str = "end_hour", share: float = 0.5, keep: int = 10) -> DataFrame:
    """Features in the top list of at least half the hours: frequency / (average rank + 1)."""
    f = _with_hour_count(top, hour).groupBy("feature").agg(F.count("*").alias("__n"), F.avg("rank").alias("average_rank"), F.max("__h").alias("__h"))
    f = f.where(F.col("__n") >= F.col("__h") * share).withColumn("frequency", F.col("__n") / F.col("__h"))
    f = f.withColumn("consistency_score", F.col("frequency") / (F.col("average_rank") + 1)).select("feature", "average_rank", "frequency", "consistency_score")
    return f.orderBy(F.col("consistency_score").desc(), "feature").limit(keep)


def hour_similarity(top: DataFrame, hour: str = "end_hour") -> DataFrame:
    """Jaccard of the top lists of every pair of hours (24 hours: 276 pairs)."""
    sets = top.groupBy(F.col(hour).alias("hour_a")).agg(F.collect_set("feature").alias("fa"))
    other = sets.withColumnsRenamed({"hour_a": "hour_b", "fa": "fb"})
    j = sets.join(other, F.col("hour_a") < F.col("hour_b"))
    return j.select("hour_a", "hour_b", (F.size(F.array_intersect("fa", "fb")) / F.size(F.array_union("fa", "fb"))).alias("similarity"))


def feature_stability(top: DataFrame, hour: str = "end_hour", absent_rank: int = 10) -> DataFrame:
    """Per feature 1 / (1 + population variance of its rank); hours without it count as rank 10. One hour alone gives 0."""
    s = _with_hour_count(top, hour).groupBy("feature").agg(
        F.count("*").alias("__n"), F.sum("rank").alias("__s"), F.sum(F.col("rank") * F.col("rank")).alias("__q"), F.max("__h").alias("__h"))
    miss = F.col("__h") - F.col("__n")
    mean = (F.col("__s") + miss * absent_rank) / F.col("__h")
    var = (F.col("__q") + miss * absent_rank * absent_rank) / F.col("__h") - mean * mean
    stable = 1 / (1 + F.greatest(var, F.lit(0.0)))
    return s.select("feature", F.when(F.col("__h") > 1, stable).otherwise(0.0).alias("stability"))


def period(hour: Column) -> Column:
    return F.when(hour.between(6, 10), "morning_hours").when(hour.between(11, 15), "midday_hours").when(hour.between(16, 20), "evening_hours").otherwise("night_hours")


def complexity_by_period(c: DataFrame, hour: str = "end_hour") -> DataFrame:
    return c.groupBy(period(F.col(hour)).alias("period")).agg(
        F.avg("complexity").alias("mean_complexity"), F.stddev_pop("complexity").alias("std_complexity"), F.count("*").alias("sample_count"))


def complexity_trend(c: DataFrame, hour: str = "end_hour") -> DataFrame:
    return c.agg(
        F.regr_slope("complexity", hour).alias("trend_slope"), F.max_by(hour, F.struct("complexity", -F.col(hour))).alias("most_complex_hour"),
        F.min_by(hour, F.struct("complexity", F.col(hour))).alias("least_complex_hour"))


def class_separation(df: DataFrame, features: list[str], label: str, keys: list[str]) -> DataFrame:
    long = df.select(*keys, F.col(label).alias("cls"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot([*keys, "cls"], features, "feature", "value")
    return long.groupBy(*keys, "feature", "cls").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def importance_ranking(imp: DataFrame, keys: list[str]) -> DataFrame:
    """Features by mean absolute importance; `_z` names map back to the base column."""
    m = imp.groupBy(*keys, F.regexp_replace("feature", "_z$", "").alias("feature")).agg(F.avg(F.abs("importance")).alias("mean_abs_importance"))
    w = Window.partitionBy(*keys).orderBy(F.col("mean_abs_importance").desc(), "feature")
    return m.withColumn("position", F.row_number().over(w))
