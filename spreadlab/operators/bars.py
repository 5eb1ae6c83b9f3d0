"""Quarter-hour prices to hourly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import rnd


def hourly_price_stats(clean: DataFrame) -> DataFrame:
    """Mean and sample deviation per hour and location; one row in the hour gives a null deviation."""
    return (
        clean.groupBy(
            F.date_trunc("hour", "utc_ts").alias("utc_ts"), F.date_trunc("hour", "local_ts").alias("local_ts"),
            "location", "location_type",
        )
        .agg(rnd(F.avg("price")).alias("price_mean"), rnd(F.stddev_samp("price")).alias("price_std"))
        .withColumn("hour_local", F.hour("local_ts"))
    )
