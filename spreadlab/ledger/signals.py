"""Predictions to trading signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.describe import fill_slots
from spreadlab.operators.quantiles import exact_quantiles
from spreadlab.session import join_measured

POINT = ["settlement_point"]
DIRECTIONS = ["long", "short", "no_trade"]


def target_hours(df: DataFrame, hours: list[int] | None) -> DataFrame:
    return df if not hours else df.where(F.col("end_hour").isin(hours))


def strategy_label(kind: str, hours: list[int] | None = None) -> str:
    return kind if not hours else f"{kind}_hours_" + "_".join(str(h) for h in sorted(hours))


def confidence(columns: list[str]) -> Column:
    """Given confidence, else the larger class probability."""
    probs = {"predicted_prob_class_0", "predicted_prob_class_1"} <= set(columns)
    best = F.greatest("predicted_prob_class_0", "predicted_prob_class_1") if probs else None
    if "prediction_confidence" in columns:
        return F.coalesce(F.col("prediction_confidence"), best) if probs else F.col("prediction_confidence")
    if not probs:
        raise ValueError("predictions carry neither a confidence nor both class probabilities")
    return best


def naive_signal(pred: DataFrame) -> DataFrame:
    return pred.withColumns({
        "direction": F.when(F.col("predicted_dart_slt") == 1, "long").otherwise("short"), "confidence": F.lit(1.0)})


def hour_thresholds(pred: DataFrame, keys: list[str] = POINT, percentile: float = 0.95) -> DataFrame:
    """Confidence percentile per hour 1..24; an hour without rows takes the overall median."""
    conf = pred.select(*keys, "end_hour", confidence(pred.columns).alias("conf"))
    cut = exact_quantiles(conf, [*keys, "end_hour"], "conf", {"cut": percentile})
    median = exact_quantiles(conf, keys, "conf", {"median": 0.5})
    counts = join_measured(conf, cut, [*keys, "end_hour"]).groupBy(*keys, "end_hour").agg(
        F.max("cut").alias("cut"), F.count("conf").alias("total_predictions"), F.count_if(F.col("conf") >= F.col("cut")).alias("n_above"))
    full = fill_slots(counts, keys, "end_hour", list(range(1, 25)), ["total_predictions", "n_above"])
    return full.join(median, keys).select(
        *keys, "end_hour", F.coalesce("cut", "median").alias("threshold"), "total_predictions", "n_above",
        F.when(F.col("total_predictions") > 0, 100.0 * F.col("n_above") / F.col("total_predictions")).otherwise(0.0).alias("pct_above"))


def sign_prob_signal(pred: DataFrame, thresholds: DataFrame, keys: list[str] = POINT) -> DataFrame:
    """Trade only at or above the hour's threshold; a missing hour or confidence is no trade.

    Thresholds may come from another split; taking them from the traded rows looks ahead.
    """
    p = pred.withColumn("confidence", confidence(pred.columns))
    j = join_measured(p, thresholds.select(*keys, "end_hour", "threshold"), [*keys, "end_hour"], "left")
    go = F.col("confidence") >= F.col("threshold")
    side = F.when(F.col("predicted_dart_slt") == 1, "long").otherwise("short")
    return j.withColumn("direction", F.when(go, side).otherwise("no_trade"))


def signal_violations(sig: DataFrame, initial_capital: float, cost: float, size: str | None = None) -> DataFrame:
    """Counts of rule breaks, with the verdict that more than a tenth of bad rows fails the run."""
    conf = F.col("confidence")
    bad_dir = ~F.coalesce(F.col("direction").isin(DIRECTIONS), F.lit(False))
    bad_conf = F.coalesce(~conf.between(0.0, 1.0) | F.isnan(conf), F.lit(True))
    bad_size = (F.col(size) < 0) | (F.col(size) > F.lit(initial_capital)) if size else F.lit(False)
    return sig.agg(
        F.count("*").alias("n_rows"), F.count_if(bad_dir).alias("bad_direction"), F.count_if(bad_conf).alias("bad_confidence"),
        F.count_if(bad_size).alias("bad_size"), F.count_if(bad_dir | bad_conf | bad_size).alias("bad_rows"),
    ).withColumns({
        "bad_setup": F.lit(not (initial_capital > 0 and 0 <= cost < initial_capital)),
        "failed": F.col("bad_rows") > 0.1 * F.col("n_rows")})
