"""Prediction tables: class, probabilities, confidence, price-space columns, joins and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import inverse_signed_log


def price_columns(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Undo the signed log of actual and predicted and take their difference."""
    return pred.withColumn("actual_price", inverse_signed_log(actual)).withColumn("predicted_price", inverse_signed_log(predicted)).withColumn(
        "price_error", F.col("predicted_price") - F.col("actual_price"))


def join_predictions(pred: DataFrame, dataset: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of predictions to dataset rows; a dataset key with several rows fails the job."""
    counted = dataset.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.first(F.struct(*[c for c in dataset.columns if c not in keys])).alias("__row"))
    guarded = counted.withColumn("__row", F.when(F.col("__n") > 1, F.raise_error(F.lit("dataset key is not unique")).cast(
        counted.schema["__row"].dataType)).otherwise(F.col("__row")))
    return pred.join(guarded.drop("__n"), keys, "left").select(*pred.columns, "__row.*")


def coverage(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.countDistinct("end_hour").alias("n_hours"), F.min("utc_ts").alias("first_ts"), F.max("utc_ts").alias("last_ts"))


def classified(scored: DataFrame, probability: str = "probability", classes: int = 2) -> DataFrame:
    """The probability of every class and the confidence, from a probability array column."""
    p = F.col(probability)
    return scored.withColumns({**{f"predicted_prob_class_{k}": F.get(p, k) for k in range(classes)}, "prediction_confidence": F.array_max(p)})


# Dashboard categories and the name prefix of their feature columns.
SERIES_PREFIXES = {"load": "load_forecast_", "wind": "wind_generation_", "solar": "solar_"}


def feature_series(joined: DataFrame, ids: list[str]) -> DataFrame:
    """All load, wind and solar columns of a joined table as rows; a `_z` suffix is dropped from the name."""
    owner = {c: k for c in joined.columns for k, p in SERIES_PREFIXES.items() if c.startswith(p)}
    names = list(owner)
    wide = joined.select(*ids, *[F.col(c).cast("double").alias(c) for c in names])
    kind = F.create_map(*[x for c, k in owner.items() for x in (F.lit(c), F.lit(k))])
    long = wide.unpivot(ids, names, "__c", "value")
    return long.select(*ids, kind[F.col("__c")].alias("category"), F.regexp_replace("__c", "_z$", "").alias("feature"), "value")
