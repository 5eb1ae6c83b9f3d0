"""Continuous target to classes, and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import col, ratio
from spreadlab.session import join_measured


def sign_class(c: str | Column) -> Column:
    return F.when(col(c) > 0, 1).when(col(c).isNotNull(), 0)


def threshold_class(c: str | Column, t: float) -> Column:
    """1 beyond the threshold on either side."""
    return F.when(F.abs(col(c)) > t, 1).when(col(c).isNotNull(), 0)


def bimodal_class(c: str | Column, low: float, high: float) -> Column:
    """0 below low, 2 above high, 1 between."""
    x = col(c)
    return F.when(x < low, 0).when(x > high, 2).when(x.isNotNull(), 1)


def manual_class(c: str | Column, bounds: list[float]) -> Column:
    """Right-closed bins between sorted boundaries."""
    x = col(c)
    out = F.when(x.isNotNull(), len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(x <= bounds[i], i).otherwise(out)
    return F.when(x.isNotNull(), out)


def kmeans_class(c: str | Column, centres: Column) -> Column:
    """Bin by midpoints of sorted cluster centres (an array column)."""
    s = F.array_sort(centres)
    mids = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: (a + b) / 2)
    return F.when(col(c).isNotNull(), F.size(F.filter(mids, lambda m: m < col(c))))


def positive_weight(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Negatives per positive, the weight of a positive row."""
    return df.groupBy(*keys).agg(ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("scale_pos_weight"))


def train_zscore(df: DataFrame, columns: list[str], keys: list[str], is_train: Column) -> DataFrame:
    """Scale all rows by mean and sample deviation of the training rows; a constant column divides by 1."""
    t = lambda c: F.when(is_train, F.col(c))
    stats = df.groupBy(*keys).agg(*[e for i, c in enumerate(columns) for e in (F.avg(t(c)).alias(f"__m{i}"), F.stddev_samp(t(c)).alias(f"__s{i}"))])
    j = join_measured(df, stats, keys, "left")
    sd = lambda i: F.when(F.col(f"__s{i}") > 1e-12, F.col(f"__s{i}")).otherwise(1.0)
    return j.select(*df.columns, *[((F.col(c) - F.col(f"__m{i}")) / sd(i)).alias(f"{c}_z") for i, c in enumerate(columns)])
