"""Study dataset: target, history, forecasts, calendar, holidays and z-scores as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.operators import calendar, encode, lags, target, vintage
from spreadlab.sources.contracts import LOAD_ZONES, SOLAR_ZONES, WIND_ZONES

# Columns left out of the z-score step (cyclical encodings and flags).
NOT_SCALED = ["etf_hour_sin", "etf_hour_cos", "etf_dow_sin", "etf_dow_cos", "etf_doy_sin", "etf_doy_cos", "etf_month_sin",
              "etf_month_cos", "etf_woy_sin", "etf_woy_cos", "etf_is_federal_holiday", "etf_is_pre_holiday",
              "etf_is_post_holiday", "etf_is_holiday_week", "etf_is_major_holiday", "is_weekend", "is_holiday"]


@dataclass
class Forecast:
    table: DataFrame
    value: str
    prefix: str
    zones: list[str]
    tie: str | None = None


def standard_forecasts(load: DataFrame, wind: DataFrame, solar: DataFrame) -> list[Forecast]:
    return [
        Forecast(load, "load_forecast", "load_forecast_", LOAD_ZONES),
        Forecast(wind, "wind_generation", "wind_generation_", WIND_ZONES),
        Forecast(solar, "solar_generation", "solar_", SOLAR_ZONES),
    ]


def build_study(rt: DataFrame, dam: DataFrame, forecasts: list[Forecast], *, holiday_pad_years: int = 1,
                with_z: bool = True) -> DataFrame:
    """Every row of the hourly real-time table with all derived columns."""
    df = target.dart_target(rt, dam)
    df = lags.history_features(calendar.calendar_features(df))
    for f in forecasts:
        df = vintage.forecast_features(df, f.table, f.value, f.zones, f.prefix, f.tie)
    df = df.select("*", *calendar.cyclical_columns())
    df = calendar.holiday_features(df, pad_years=holiday_pad_years, years_of=rt)
    if with_z:
        scaled = [c for c in encode.feature_columns(df.columns) if c not in NOT_SCALED]
        df = encode.zscore(df, scaled)
    return df


def finalize_study(study: DataFrame) -> DataFrame:
    return encode.finalize(study, "dart_slt", encode.feature_columns(study.columns))
