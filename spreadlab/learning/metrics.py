"""Regression and classification metrics per group as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import col, ratio
from spreadlab.operators.blocks import previous, time_block
from spreadlab.session import join_measured


def finite(c: str | Column) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows whose actual and predicted values are both finite."""
    return df.where(finite(actual) & finite(predicted)).withColumn("__y", F.col(actual).cast("double")).withColumn("__p", F.col(predicted).cast("double"))


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str, floor: float = 1.0) -> DataFrame:
    """R2, MAE, RMSE, and the two percentage errors where values exceed the floor."""
    y, p = F.col("__y"), F.col("__p")
    e = y - p
    big, scale = F.abs(y) > floor, (F.abs(y) + F.abs(p)) / 2
    n = F.count("*")
    out = pairs(df, actual, predicted).groupBy(*keys).agg(
        n.alias("n"), F.sum(e * e).alias("__sse"), F.var_pop(y).alias("__vy"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(big, F.abs(e / F.when(y != 0, y)) * 100)).alias("mape"), F.count_if(big).alias("mape_sample_count"),
        F.avg(F.when(scale > floor, F.abs(e) / F.when(scale > 0, scale) * 100)).alias("smape"), F.count_if(scale > floor).alias("smape_sample_count"))
    return out.withColumn("r2", 1 - ratio(F.col("__sse"), F.col("__vy") * F.col("n"))).drop("__sse", "__vy")


# Metrics that are stored with every model.
CORE = ("r2", "mae", "rmse")


def core(measured: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """The core subset of a metric table under prefixed names."""
    return measured.select(*keys, *[F.col(m).alias(f"{prefix}{m}") for m in CORE])


def directional_accuracy(df: DataFrame, keys: list[str], actual: str, predicted: str, order: list[str], ts: str = "utc_ts") -> DataFrame:
    """Share of equal change signs in time order, and MAE over the mean absolute change."""
    s = previous(pairs(df, actual, predicted), keys, order, time_block(ts), {"__y0": "__y", "__p0": "__p"})
    dy, dp = F.col("__y") - F.col("__y0"), F.col("__p") - F.col("__p0")
    hit = F.when(dy.isNotNull(), (F.signum(dy) == F.signum(dp)).cast("int"))
    return s.groupBy(*keys).agg(
        (100.0 * F.avg(hit)).alias("directional_accuracy"), F.count(hit).alias("directional_accuracy_sample_count"),
        ratio(F.avg(F.abs(F.col("__y") - F.col("__p"))), F.avg(F.abs(dy))).alias("mase"))


def spike_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str, sigmas: float = 2.0) -> DataFrame:
    """Precision, recall, F1 of values above mean + 2 population deviations of the truth; null without spikes."""
    q = pairs(df, actual, predicted)
    cut = q.groupBy(*keys).agg((F.avg("__y") + sigmas * F.stddev_pop("__y")).alias("__cut"))
    t, p = F.col("__y") > F.col("__cut"), F.col("__p") > F.col("__cut")
    c = join_measured(q, cut, keys).groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(t).alias("spike_count_true"), F.count_if(p).alias("spike_count_pred"))
    some = (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    pr, rc = zero(ratio("tp", F.col("tp") + F.col("fp"))), zero(ratio("tp", F.col("tp") + F.col("fn")))
    return c.select(*keys, F.when(some, pr).alias("spike_precision"), F.when(some, rc).alias("spike_recall"),
                    F.when(some, zero(ratio(2 * pr * rc, pr + rc))).alias("spike_f1_score"), "spike_count_true", "spike_count_pred")


def robustness_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    ok = finite(actual) & finite(predicted)
    y, p = F.when(ok, F.col(actual)), F.when(ok, F.col(predicted))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("total_samples"), F.count_if(ok).alias("finite_samples"),
        (F.max(y) - F.min(y)).alias("price_range_true"), F.avg(y).alias("price_mean_true"), F.stddev_pop(y).alias("price_std_true"),
        (F.max(p) - F.min(p)).alias("price_range_pred"), F.avg(p).alias("price_mean_pred"), F.stddev_pop(p).alias("price_std_pred"))
    return out.withColumn("finite_sample_rate", F.coalesce(ratio("finite_samples", "total_samples"), F.lit(0.0)))


def confusion(df: DataFrame, keys: list[str], actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Long confusion table (keys, actual, predicted, n); all class metrics derive from it."""
    n = F.sum(weight) if weight else F.count("*")
    out = df.groupBy(*keys, F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(n.alias("n"))
    return out.where("n > 0") if weight else out


def per_class(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class (0 on zero division)."""
    same = F.col("actual") == F.col("predicted")
    legs = F.array(
        F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("called")))
    c = conf.withColumn("n", F.col("n").cast("long")).select(*keys, F.inline(legs)).groupBy(*keys, "cls").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("called").alias("called"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.withColumn("precision", zero(ratio("tp", "called"))).withColumn("recall", zero(ratio("tp", "support")))
    return c.withColumn("f1", zero(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def classification_metrics(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy with support-weighted and macro averages."""
    c = per_class(conf, keys)
    s = F.sum("support")
    w = lambda m: (F.sum(F.col("support") * F.col(m)) / s).alias(m)
    return c.groupBy(*keys).agg(
        (F.sum("tp") / s).alias("accuracy"), w("precision"), w("recall"), w("f1"), F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"), F.count("*").alias("n_classes"),
        F.sum("tp").alias("correct_predictions"), s.alias("total_predictions"))


def confusion_matrix(conf: DataFrame, keys: list[str], classes: list[int]) -> DataFrame:
    """Pivoted matrix with trace share per actual class."""
    m = conf.groupBy(*keys, "actual").pivot("predicted", classes).agg(F.sum("n"))
    m = m.select(*keys, "actual", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"pred_{c}") for c in classes])
    row = sum((F.col(f"pred_{c}") for c in classes), F.lit(0))
    own = F.lit(0)
    for c in classes:
        own = F.when(F.col("actual") == c, F.col(f"pred_{c}")).otherwise(own)
    return m.withColumn("class_accuracy", ratio(own, row))


def class_share(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    c = df.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("cls")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per class
    return c.withColumn("share", F.col("n") / total)


def hourly_performance(results: DataFrame, baseline: float, hour: str = "end_hour", best: int = 5) -> DataFrame:
    """Per hour over its models: mean and deviation of accuracy and F1, overfit gap, below-baseline count, rank flags."""
    h = results.groupBy(hour).agg(
        F.avg("validation_accuracy").alias("mean_accuracy"), F.stddev_samp("validation_accuracy").alias("std_accuracy"),
        F.avg("validation_f1").alias("mean_f1"), F.stddev_samp("validation_f1").alias("std_f1"),
        F.avg(F.col("train_accuracy") - F.col("validation_accuracy")).alias("overfit_gap"), F.count_if(F.col("validation_accuracy") < baseline).alias("n_below_baseline"))
    top, low = Window.orderBy(F.col("mean_accuracy").desc(), hour), Window.orderBy("mean_accuracy", hour)  # 24 rows
    return h.withColumns({"is_top": F.row_number().over(top) <= best, "is_bottom": F.row_number().over(low) <= best})


def representative_hours(perf: DataFrame, hour: str = "end_hour") -> DataFrame:
    """Best, worst and (lower) median hour by mean accuracy; at most 24 rows come in."""
    up = Window.orderBy("mean_accuracy", hour)
    r = perf.select(hour, "mean_accuracy", F.row_number().over(up).alias("__pos"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("__n"))
    best, worst = F.struct(F.col("mean_accuracy"), -F.col(hour)), F.struct("mean_accuracy", hour)
    return r.agg(F.max_by(hour, best).alias("best_hour"), F.min_by(hour, worst).alias("worst_hour"),
                 F.max(F.when(F.col("__pos") == F.floor((F.col("__n") + 1) / 2), F.col(hour))).alias("median_hour"))
