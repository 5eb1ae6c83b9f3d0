"""Raw to clean to hourly, with the checks as separate small tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.functions.timeconv import (
    delivery_hour_to_start, hour_ending_to_start, with_interval_offset, with_utc,
)
from spreadlab.operators import bars, clean
from spreadlab.plans import landing
from spreadlab.sources.contracts import POINT_PREFIXES


@dataclass
class EtlResult:
    clean: DataFrame
    transformed: DataFrame | None = None
    checks: dict[str, DataFrame] = field(default_factory=dict)

    def failures(self) -> list[str]:
        """Names of failed checks; each check is one small aggregate, evaluated here."""
        bad = []
        for name, df in self.checks.items():
            rows = df.where(~F.col("passed")).limit(1) if "passed" in df.columns else df.limit(1)
            if not rows.isEmpty():
                bad.append(name)
        return bad

    def require_valid(self) -> "EtlResult":
        bad = self.failures()
        if bad:
            raise ValueError(f"validation failed: {bad}")
        return self


def normalise_rt(raw: DataFrame) -> DataFrame:
    """Delivery date, hour and quarter to local and UTC clocks."""
    df = raw.withColumn("hourEnding", F.col("deliveryHour")).withColumn(
        "start_hour", delivery_hour_to_start("hourEnding")
    )
    return with_interval_offset(with_utc(df))


def normalise_hourly(raw: DataFrame) -> DataFrame:
    """Delivery date and "HH:00" label to local and UTC clocks."""
    return with_utc(raw.withColumn("start_hour", hour_ending_to_start("hourEnding")))


def etl_rt(raw: DataFrame) -> EtlResult:
    cleaned = clean.clean_rt(normalise_rt(raw))
    return EtlResult(
        cleaned, bars.hourly_price_stats(cleaned),
        {
            "keys_present": clean.validate_not_null(cleaned, ["utc_ts", "local_ts", "location", "price"]),
            "location_domain": clean.validate_domain(cleaned, "location", prefixes=POINT_PREFIXES),
            "location_type": clean.validate_nonempty(cleaned),
            "temporal": clean.completeness(cleaned).withColumnRenamed("complete", "passed"),
        },
    )


def land_rt(raw: DataFrame, path: str, complete: bool = True) -> T.StructType:
    """Raw quarter hours to the hourly layer at path, or ChecksFailed and the old layer; returns the layer's schema."""
    cleaned = clean.clean_rt(normalise_rt(raw))
    checks = landing.key_checks(["utc_ts", "local_ts", "location", "price"]) | landing.domain_checks("location", prefixes=POINT_PREFIXES)
    checks["location_type_blank"] = F.count_if(F.col("location_type").isNull() | (F.trim("location_type") == ""))
    landing.land(cleaned, path, checks, bars.hourly_price_stats, complete=complete)
    return bars.hourly_price_stats(cleaned).schema


def etl_dam(raw: DataFrame) -> EtlResult:
    cleaned = clean.clean_dam(normalise_hourly(raw))
    return EtlResult(cleaned, None, {
        "keys_present": clean.validate_not_null(cleaned, ["utc_ts", "local_ts", "location", "price"]),
        "location_domain": clean.validate_domain(cleaned, "location", prefixes=POINT_PREFIXES),
        "temporal": clean.completeness(cleaned).withColumnRenamed("complete", "passed"),
    })


def etl_lambda(raw: DataFrame) -> EtlResult:
    cleaned = clean.clean_lambda(normalise_hourly(raw))
    return EtlResult(cleaned, None, {
        "keys_present": clean.validate_not_null(cleaned, ["utc_ts", "local_ts", "price"]),
        "temporal": clean.completeness(cleaned).withColumnRenamed("complete", "passed"),
    })


def etl_forecast(raw: DataFrame, zones: list[str], value: str, *, load: bool = False) -> EtlResult:
    normalised = normalise_hourly(raw) if dict(raw.dtypes)["hourEnding"] == "string" else with_utc(
        raw.withColumn("start_hour", delivery_hour_to_start("hourEnding")))
    cleaned = clean.clean_forecast(normalised, zones, value, in_use_only=load, drop_null_values=not load)
    return EtlResult(cleaned, None, {
        "keys_present": clean.validate_not_null(cleaned, ["posted_datetime", "utc_ts", "local_ts", "location", value]),
        "zone_domain": clean.validate_domain(cleaned, "location", members=zones),
    })
