"""Table contracts: declared schemas, zone lists and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Input column names published by the market operator.
LOAD_ZONES = ["coast", "east", "farWest", "north", "northCentral", "southCentral", "southern", "west"]
WIND_ZONES = [
    "COPHSLCoastal", "COPHSLNorth", "COPHSLPanhandle", "COPHSLSouth", "COPHSLSystemWide", "COPHSLWest",
    "genCoastal", "genNorth", "genPanhandle", "genSouth", "genSystemWide", "genWest", "HSLSystemWide",
    "STWPFCoastal", "STWPFNorth", "STWPFPanhandle", "STWPFSouth", "STWPFSystemWide", "STWPFWest",
    "WGRPPCoastal", "WGRPPNorth", "WGRPPPanhandle", "WGRPPSouth", "WGRPPSystemWide", "WGRPPWest",
]
SOLAR_ZONES = [
    "COPHSLCenterEast", "COPHSLCenterWest", "COPHSLFarEast", "COPHSLFarWest", "COPHSLNorthWest", "COPHSLSouthEast", "COPHSLSystemWide",
    "genCenterEast", "genCenterWest", "genFarEast", "genFarWest", "genNorthWest", "genSouthEast", "genSystemWide", "HSLSystemWide",
    "PVGRPPCenterEast", "PVGRPPCenterWest", "PVGRPPFarEast", "PVGRPPFarWest", "PVGRPPNorthWest", "PVGRPPSouthEast", "PVGRPPSystemWide",
    "STPPFCenterEast", "STPPFCenterWest", "STPPFFarEast", "STPPFFarWest", "STPPFNorthWest", "STPPFSouthEast", "STPPFSystemWide",
]
# Settlement points that can be collected; queries take the wanted ones as a parameter.
SETTLEMENT_POINTS = [
    "HB_BUSAVG", "HB_HOUSTON", "HB_HUBAVG", "HB_NORTH", "HB_PAN", "HB_SOUTH", "HB_WEST",
    "LZ_AEN", "LZ_CPS", "LZ_HOUSTON", "LZ_LCRA", "LZ_NORTH", "LZ_RAYBN", "LZ_SOUTH", "LZ_WEST",
]
POINT_PREFIXES = ["LZ_", "HB_"]


def _zones(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


# DDL text, so that importing this module needs no session.
# Declared schemas of the published input files.
SCHEMAS = {
    "rt_spp": (
        "deliveryDate date, deliveryHour int, deliveryInterval int, settlementPoint string, "
        "settlementPointType string, settlementPointPrice double, DSTFlag boolean, utc_ts timestamp, local_ts timestamp"
    ),
    "dam_spp": (
        "deliveryDate date, hourEnding string, settlementPoint string, settlementPointPrice double, "
        "DSTFlag boolean, utc_ts timestamp, local_ts timestamp"
    ),
    "dam_system_lambda": (
        "deliveryDate date, hourEnding string, systemLambda double, DSTFlag boolean, utc_ts timestamp, local_ts timestamp"
    ),
    "load_forecast": (
        f"postedDatetime timestamp, deliveryDate date, hourEnding string, {_zones(LOAD_ZONES)}, "
        "inUseFlag boolean, DSTFlag boolean, utc_ts timestamp, local_ts timestamp"
    ),
    "wind_power_gen": (
        f"postedDatetime timestamp, deliveryDate date, hourEnding int, {_zones(WIND_ZONES)}, "
        "DSTFlag boolean, utc_ts timestamp, local_ts timestamp"
    ),
    "solar_power_gen": (
        f"postedDatetime timestamp, deliveryDate date, hourEnding int, {_zones(SOLAR_ZONES)}, "
        "DSTFlag boolean, utc_ts timestamp, local_ts timestamp"
    ),
}

# Column names of prediction tables.
PREDICTION_COLUMNS = ["utc_ts", "actual_dart_slt", "predicted_dart_slt", "end_hour"]
PREDICTION_OPTIONAL = ["prediction_confidence", "predicted_prob_class_0", "predicted_prob_class_1"]


def require_columns(df: DataFrame, needed: list[str], name: str = "table") -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}; has {df.columns}")
    return df
