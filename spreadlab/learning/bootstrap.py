"""Bootstrap without refitting, and summaries over replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.learning.linear import by_replicate, resampled
from spreadlab.learning.metrics import classification_metrics, confusion, finite

# Metrics summarised for classifiers.
CLASS_METRICS = ["accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro", "finite_sample_rate",
                 "n_classes", "correct_predictions", "total_predictions"]


def bootstrap_classification(df: DataFrame, keys: list[str], actual: str, predicted: str, row_id: Column, n: int = 20, seed: int = 0) -> DataFrame:
    """Metrics per replicate of as many draws as a group has rows, from weighted confusion counts (they combine map-side)."""
    by = [*keys, "replicate"]
    r = by_replicate(resampled(df.select(*keys, actual, predicted, row_id.alias("__id")), keys, F.col("__id"), n, seed, [actual, predicted]))
    return classification_metrics(confusion(r, by, actual, predicted, "weight"), by)


def metric_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(keys, metrics, "metric", "value")


def bootstrap_summary(long: DataFrame, keys: list[str], classification: bool = False) -> DataFrame:
    """Mean, deviation, counts and success rate per metric over replicates.

    Regression: sample deviation (0 for one replicate). Classification: population deviation.
    """
    v = F.when(finite("value"), F.col("value"))
    sd = F.stddev_pop(v) if classification else F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
    return long.groupBy(*keys, "metric").agg(
        F.avg(v).alias("mean"), sd.alias("std"), F.count(v).alias("count"), (F.count("*") - F.count(v)).alias("nan_count"),
        (F.count(v) / F.count("*")).alias("success_rate"))


def flat_metrics(summary: DataFrame, keys: list[str], metrics: list[str], stats: list[str] = ["mean", "std"], prefix: str = "bootstrap_") -> DataFrame:
    """One row per key with columns prefix_metric_stat."""
    return summary.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{prefix}{m}_{s}") for m in metrics for s in stats])


def flat_class_metrics(per_class: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Mean, minimum and maximum over classes of precision, recall and F1."""
    return per_class.groupBy(*keys).agg(*[
        e for m in ("precision", "recall", "f1") for e in (F.avg(m).alias(f"{prefix}mean_per_class_{m}"), F.min(m).alias(f"{prefix}min_per_class_{m}"), F.max(m).alias(f"{prefix}max_per_class_{m}"))])
