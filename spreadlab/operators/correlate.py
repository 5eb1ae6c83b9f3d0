"""Co-moments per group and what follows from them: correlations and fit quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.functions.columns import ratio
from spreadlab.session import join_measured

JVM_COLUMNS = 12
HELD_CELLS = 8_000_000  # doubles a task keeps before it passes sums on


def co_moments(df: DataFrame, keys: list[str], columns: list[str], jvm_columns: int = JVM_COLUMNS) -> DataFrame:
    """Long table (keys, a, b, n, mean_a, mean_b, cov) over complete rows, a <= b by list position.

    Few columns: one aggregation of covariances. Many: rows are centred on the group
    mean, each task adds up its own outer products, and Spark sums the task results.
    """
    src = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    if len(columns) <= jvm_columns:
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        packed = F.array(*[
            F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.count("*").alias("n"),
                     F.avg(columns[i]).alias("mean_a"), F.avg(columns[j]).alias("mean_b"), F.covar_pop(columns[i], columns[j]).alias("cov"))
            for i, j in pairs])
        return src.groupBy(*keys).agg(packed.alias("m")).select(*keys, F.inline("m"))
    means = src.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("means"))
    centred = join_measured(src, means.select(*keys, "means"), keys).select(
        *keys, F.array(*[F.col(c) - F.col("means")[i] for i, c in enumerate(columns)]).alias("x"))
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())])
    iu, ju = np.triu_indices(len(columns))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, g in held.items():
                head = {k: pd.Series([v] * len(iu), dtype="object") for k, v in zip(keys, key)}
                yield pd.DataFrame({**head, "i": iu.astype("int32"), "j": ju.astype("int32"), "s": g[iu, ju]})
            held.clear()

        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                x = np.vstack(part["x"].to_numpy())
                held[key] = held.get(key, 0.0) + x.T @ x
            if len(held) * len(columns) ** 2 > HELD_CELLS:
                yield from flush()
        yield from flush()

    sums = centred.mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.join(means, keys).select(
        *keys, names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "n",
        F.col("means")[F.col("i")].alias("mean_a"), F.col("means")[F.col("j")].alias("mean_b"), (F.col("s") / F.col("n")).alias("cov"))


def correlation_matrix(df: DataFrame, keys: list[str], columns: list[str], jvm_columns: int = JVM_COLUMNS) -> DataFrame:
    """Pearson r of every column pair (both orders) over complete rows."""
    m = co_moments(df, keys, columns, jvm_columns)
    var = m.where("a = b").select(*keys, F.col("a").alias("v"), F.sqrt("cov").alias("sd"))
    va = var.withColumnsRenamed({"v": "a", "sd": "sd_a"})
    vb = var.withColumnsRenamed({"v": "b", "sd": "sd_b"})
    r = m.join(va, [*keys, "a"]).join(vb, [*keys, "b"]).select(
        *keys, "a", "b", "n", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(
            ratio(F.col("cov"), F.col("sd_a") * F.col("sd_b"))).alias("r"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return r.select(*keys, "n", "r", F.inline(both))


def top_correlations(corr: DataFrame, keys: list[str], target: str, top: int = 10) -> DataFrame:
    """Strongest |r| with the target; the table has one row per feature, so ranking is small."""
    t = corr.where((F.col("a") == target) & (F.col("b") != target) & F.col("r").isNotNull()).select(*keys, F.col("b").alias("feature"), "r")
    w = Window.partitionBy(*keys).orderBy(F.abs("r").desc(), "feature")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# Correlation categories and the name prefixes they take.
CATEGORIES = {"dart": ["dart_slt_lag_", "dart_slt_roll_"], "load": ["load_forecast_"], "solar": ["solar_"],
              "wind": ["wind_generation_"], "etf": ["etf_"]}


def category_columns(columns: list[str], category: str) -> list[str]:
    return [c for c in columns if any(c.startswith(p) for p in CATEGORIES[category])]


def nonzero_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where at least one of the columns is not zero."""
    total = sum((F.abs(F.col(c)) for c in columns), F.lit(0.0))
    return df.where(total != 0)


def feature_relation(df: DataFrame, x: str, y: str, keys: list[str], hour: str = "end_of_hour", weekend: str = "is_weekend",
                     min_total: int = 100, min_hour: int = 5, min_fit: int = 10) -> DataFrame:
    """Per hour: counts, means, deviations, r, linear R2 and quadratic R2 of y on x."""
    by = [*keys, hour]
    src = df.select(*by, weekend, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    base = src.groupBy(*by).agg(
        F.count("*").alias("n_points"), F.count_if(~F.col(weekend)).alias("n_weekday"), F.count_if(F.col(weekend)).alias("n_weekend"),
        F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("std_y"), F.avg("x").alias("mean_x"), F.stddev_samp("x").alias("std_x"),
        F.corr("x", "y").alias("correlation"))
    enough = base.groupBy(*keys).agg(F.sum("n_points").alias("__t")).where(F.col("__t") >= min_total).drop("__t")
    base = base.join(enough, keys, "left_semi").where(F.col("n_points") >= min_hour)
    c = join_measured(src, base.select(*by, F.col("mean_x").alias("__mx"), F.col("mean_y").alias("__my")), by)
    u, v = F.col("x") - F.col("__mx"), F.col("y") - F.col("__my")
    q = c.groupBy(*by).agg(F.covar_pop(u, u).alias("uu"), F.covar_pop(u, u * u).alias("uw"), F.covar_pop(u * u, u * u).alias("ww"),
                           F.covar_pop(u, v).alias("uy"), F.covar_pop(u * u, v).alias("wy"), F.covar_pop(v, v).alias("yy"))
    det = F.col("uu") * F.col("ww") - F.col("uw") * F.col("uw")
    fit = (F.col("uy") * F.col("uy") * F.col("ww") - 2 * F.col("uy") * F.col("wy") * F.col("uw") + F.col("wy") * F.col("wy") * F.col("uu")) / det
    lin = ratio(F.col("uy") * F.col("uy"), F.col("uu") * F.col("yy"))
    quad = F.when(F.col("yy") > 0, F.when(det > 1e-12 * F.col("uu") * F.col("ww"), fit / F.col("yy")).otherwise(lin))
    q = q.select(*by, lin.alias("r2_linear"), quad.alias("r2_quadratic"))
    j = base.join(q, by)
    ok = F.col("n_points") > min_fit
    return j.withColumn("r2_linear", F.when(ok, F.col("r2_linear"))).withColumn("r2_quadratic", F.when(ok, F.col("r2_quadratic")))
