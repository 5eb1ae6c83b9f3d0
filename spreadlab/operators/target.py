"""Spread target: real-time minus day-ahead, and its signed logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import rnd, signed_log


def join_prices(rt: DataFrame, dam: DataFrame) -> DataFrame:
    """Every real-time row keeps its place; one day-ahead price serves all location types."""
    day_ahead = dam.select("utc_ts", "location", F.col("price").alias("dam_spp_price"))
    real_time = rt.withColumnRenamed("price_mean", "rt_spp_price")
    return real_time.join(day_ahead, ["utc_ts", "location"], "left")


def dart_target(rt: DataFrame, dam: DataFrame) -> DataFrame:
    j = join_prices(rt, dam)
    return j.withColumn("dart", rnd(F.col("rt_spp_price") - F.col("dam_spp_price"))).withColumn(
        "dart_slt", signed_log("dart")
    )


def duplicate_prices(prices: DataFrame, keys: tuple[str, ...] = ("utc_ts", "location")) -> DataFrame:
    """Keys with several prices, which would fan out the left join; empty for a sound day-ahead table."""
    return prices.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
