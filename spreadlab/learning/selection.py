"""Grid and trial summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.operators.quantiles import exact_quantiles, with_quantiles

# Tuned preset for boosted classifiers.
TUNED_PRESET = {"max_depth": 5, "n_estimators": 72, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 1, "reg_lambda": 2,
                "min_child_weight": 3, "scale_pos_weight": 1.35}


def alpha_grid_summary(hourly: DataFrame) -> DataFrame:
    """Per alpha over hours: mean and population deviation of both R2 kinds, hours trained, and the best alphas."""
    s = hourly.groupBy("alpha").agg(
        F.avg("bootstrap_r2").alias("avg_bootstrap_r2"), F.stddev_pop("bootstrap_r2").alias("std_bootstrap_r2"),
        F.avg("validation_r2").alias("avg_validation_r2"), F.stddev_pop("validation_r2").alias("std_validation_r2"), F.count("*").alias("n_hours_trained"))
    s = with_quantiles(s, exact_quantiles(hourly, ["alpha"], "validation_r2", {"median_validation_r2": 0.5}), ["alpha"])
    grid = Window.partitionBy(F.lit(1))  # one row per alpha
    best = lambda c: F.max_by("alpha", F.struct(F.col(c), -F.col("alpha"))).over(grid) == F.col("alpha")
    return s.withColumns({"best_by_mean": best("avg_validation_r2"), "best_by_median": best("median_validation_r2")})


def tuning_score(trials: DataFrame, penalty: float = 0.1) -> DataFrame:
    """Validation accuracy less a penalty on an overfit gap beyond 0.1."""
    gap = F.col("train_accuracy") - F.col("validation_accuracy")
    return trials.withColumns({"overfit_gap": gap, "score": F.col("validation_accuracy") - penalty * F.greatest(F.lit(0.0), gap - 0.1)})


def best_trials(scored: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Best trial per key, as an aggregate."""
    row = F.max_by(F.struct(*[c for c in scored.columns if c not in keys]), F.struct(F.col("score"), -F.col(tie)))
    return scored.groupBy(*keys).agg(row.alias("r")).select(*keys, "r.*")


def median_parameters(best: DataFrame, params: list[str]) -> DataFrame:
    """Median of each parameter over the best trials (one row per hour)."""
    return best.agg(*[F.percentile(p, 0.5).alias(p) for p in params])
