"""Encodings, standardisation, noise twin and the final cut of the study dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import uniform_hash
from spreadlab.session import join_measured

KEYS = ["location", "location_type"]


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Text labels to codes 0.. in label order, as doubles; null counts as the label "None".

    The label table has one row per distinct label, so this is for category columns.
    """
    out = out or f"{column}_le"
    text = F.col(column).cast("string")
    if dict(df.dtypes)[column] == "boolean":
        text = F.initcap(text)
    text = F.coalesce(text, F.lit("None"))
    labelled = df.withColumn("__label", text)
    codes = labelled.select("__label").distinct().withColumn(
        "__code", (F.row_number().over(Window.orderBy("__label")) - 1).cast("double"))
    return labelled.join(codes, "__label").drop("__label", *([column] if out == column else [])).withColumnRenamed("__code", out)


def one_hot(df: DataFrame, column: str = "day_of_week", values=range(7)) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values}).drop(column)


def column_stats(df: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Long table per key and column: mean, sample deviation, min, max."""
    packed = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns
    ])
    return df.groupBy(*keys).agg(packed.alias("a")).select(*keys, F.inline("a"))


def zscore(df: DataFrame, columns: list[str], keys: list[str] = KEYS, suffix: str = "_z") -> DataFrame:
    """Population z-score per key; nulls ignored, a constant column gives zeros.

    Statistics come from one partial aggregation and return as one row per key, instead
    of a window that would hold a whole key in one task.
    """
    stats = df.groupBy(*keys).agg(*[e for i, c in enumerate(columns) for e in (
        F.avg(c).alias(f"__m{i}"), F.stddev_pop(c).alias(f"__s{i}"))])
    j = join_measured(df, stats, keys, "left")
    return j.select(*df.columns, *[
        ((F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") > 1e-12, F.col(f"__s{i}")).otherwise(1.0)).alias(f"{c}{suffix}")
        for i, c in enumerate(columns)
    ])


def standard_normal(row_id: str | Column, stream: int) -> Column:
    """N(0,1) draw per (row, stream) by Box-Muller on two hashed uniforms; stable across re-runs."""
    u1 = F.greatest(uniform_hash(row_id, 2 * stream), F.lit(1e-15))
    u2 = uniform_hash(row_id, 2 * stream + 1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(u2 * (2.0 * 3.141592653589793))


def noise_twin(df: DataFrame, columns: list[str], row_id: str | Column, keys: list[str] = KEYS) -> DataFrame:
    """Every feature replaced by standard normal noise `*_n01` and its z-score."""
    noisy = df.withColumns({f"{c}_n01": standard_normal(row_id, i) for i, c in enumerate(columns)}).drop(*columns)
    return zscore(noisy, [f"{c}_n01" for c in columns], keys)


def finalize(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Rows with a target and every feature present."""
    return df.where(F.col(target).isNotNull()).dropna(subset=features)


def cleaning_summary(df: DataFrame, target: str, features: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Row counts before, after the target cut and after the feature cut, in one pass."""
    has_target = F.col(target).isNotNull()
    complete = has_target
    for f in features:
        complete = complete & F.col(f).isNotNull()
    out = df.groupBy(*keys).agg(
        F.count("*").alias("rows_before"), F.count_if(has_target).alias("rows_with_target"), F.count_if(complete).alias("rows_after"))
    return out.withColumn("pct_removed", 100.0 * (F.col("rows_before") - F.col("rows_after")) / F.col("rows_before"))


META = ["utc_ts", "local_ts", "end_of_hour", "location", "location_type"]


def feature_columns(columns: list[str], variant: str = "exp2", history: bool = True) -> list[str]:
    """Feature list of a study dataset by name rules; the three variants differ in time features.

    Without `history`, the lags and rolling statistics of the target are left out.
    """
    base = [c for c in columns if not c.endswith("_z")]
    pick = lambda test: sorted(c for c in base if test(c))
    lags, rolls = (pick(lambda c, p=p: p in c) if history else [] for p in ("dart_slt_lag_", "dart_slt_roll_"))
    onehot = pick(lambda c: c.startswith("day_of_week_"))
    if variant == "exp0":
        return lags + rolls + [c for c in ("is_weekend", "is_holiday") if c in base] + onehot
    forecasts = [c for p in ("load_forecast_", "wind_generation_", "solar_") for c in pick(lambda c, p=p: p in c and "_slt" in c)]
    if variant == "exp1":
        return lags + rolls + forecasts + pick(lambda c: c in ("is_weekend_le", "is_holiday_le")) + onehot
    return lags + rolls + forecasts + pick(lambda c: c.startswith("etf_"))


def model_ready(df: DataFrame, variant: str = "exp2", target: str = "dart_slt", history: bool = True) -> DataFrame:
    """Keys, target and the selected features as doubles."""
    feats = feature_columns(df.columns, variant, history)
    kinds = dict(df.dtypes)
    num = lambda c: (F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("double").alias(c)
    return df.select(*[c for c in META if c in df.columns], num(target), *[num(c) for c in feats])


def feature_completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n_present"), F.count("*").alias("n_rows")) for c in columns])
    return df.agg(packed.alias("a")).select(F.inline("a")).withColumn(
        "pct_present", F.when(F.col("n_rows") > 0, 100.0 * F.col("n_present") / F.col("n_rows")))
