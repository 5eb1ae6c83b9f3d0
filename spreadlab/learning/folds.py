"""Train / validation splits: by year, and weekly walk-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = 7 * 86400


def year_split(df: DataFrame, train_year: int = 2024, validation_year: int = 2025, ts: str = "utc_ts") -> DataFrame:
    y = F.year(ts)
    return df.withColumn("split", F.when(y == train_year, "train").when(y == validation_year, "validation").otherwise("ignore"))


def first_sunday(start: str) -> Column:
    """First Sunday on or after a date."""
    d = F.lit(start).cast("date")
    return F.date_add(d, F.pmod(6 - F.weekday(d), F.lit(7)))


def operational_weeks(df: DataFrame, start: str = "2025-01-01", max_weeks: int | None = None, ts: str = "utc_ts") -> DataFrame:
    """Sunday-Saturday weeks whose Saturday (midnight) lies within the data; one row per week."""
    end = df.agg(F.max(ts).alias("data_end")).withColumn("first", first_sunday(start))
    last_sunday = F.date_sub(F.to_date("data_end"), 6)
    weeks = end.where(F.col("first") <= last_sunday).select(
        F.posexplode(F.sequence("first", last_sunday, F.expr("INTERVAL 7 DAYS"))).alias("i", "val_start_date"))
    if max_weeks is not None:
        weeks = weeks.where(F.col("i") < max_weeks)
    stop = F.date_add("val_start_date", 6)
    text = F.concat(F.date_format("val_start_date", "MMM dd"), F.lit(" - "), F.date_format(stop, "MMM dd, yyyy"))
    return weeks.select(
        (F.col("i") + 1).alias("week_num"), text.alias("week_description"), F.date_sub("val_start_date", 1).alias("train_end_date"),
        "val_start_date", stop.alias("val_end_date"))


def assign_folds(df: DataFrame, start: str = "2025-01-01", ts: str = "utc_ts", midnight_cut: bool = False) -> DataFrame:
    """Each row once: the week that validates on it and the first week that trains on it.

    A row trains every later week too, so this stands for the rows-by-weeks expansion
    without copying rows. midnight_cut reproduces the published cut at Saturday 00:00.
    """
    first = F.unix_seconds(first_sunday(start).cast("timestamp"))
    sec = F.unix_seconds(ts)
    val = F.floor((sec - first) / WEEK) + 1
    if midnight_cut:
        train = F.ceil((F.unix_micros(ts) / 1e6 + 86400 - first) / WEEK) + 1
    else:
        train = F.floor((sec - first) / WEEK) + 2
    return df.withColumns({
        "val_week": F.when(sec >= first, val).cast("int"), "first_train_week": F.greatest(F.lit(1), train.cast("int"))})


def fold_sizes(folds: DataFrame, weeks: DataFrame) -> DataFrame:
    """Training and validation rows per week from per-week counts and their running sum."""
    add = folds.groupBy(F.col("first_train_week").alias("week_num")).agg(F.count("*").alias("added"))
    val = folds.where("val_week is not null").groupBy(F.col("val_week").alias("week_num")).agg(F.count("*").alias("n_validation"))
    w = weeks.join(add, "week_num", "left").join(val, "week_num", "left").na.fill(0, ["added", "n_validation"])
    total = F.sum("added").over(Window.orderBy("week_num").rowsBetween(Window.unboundedPreceding, 0))  # one row per week
    return w.withColumn("n_train", total).drop("added")
