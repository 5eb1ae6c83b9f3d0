"""Queries over the feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadlab.catalog.oracle_parts import LOCAL, r6, slt
from spreadlab.catalog.registry import query
from spreadlab.functions.columns import rnd
from spreadlab.operators import calendar, encode, lags, vintage
from spreadlab.plans.study import Forecast, build_study, finalize_study

ZONES = ["click", "error", "purchase", "signup", "view"]
PT = "PARTITION BY location, location_type"


def _forecast(b):
    return Forecast(b.forecast_vintage, "value", "load_forecast_", ZONES, tie="event_id")


def holiday_sql(d: str) -> str:
    """Predicate form of the holiday rules over a DATE expression."""
    md = lambda x: f"(month({x}) * 100 + day({x}))"
    fixed = [(101, 1871), (119, 1931), (302, 1874), (331, 2000), (421, 1875), (619, 1980), (704, 1871), (827, 1973),
             (1111, 1938), (1224, 1981), (1225, 1871), (1226, 1981)]
    moving = [(101, 1871), (619, 2021), (704, 1871), (1111, 1938), (1225, 1871)]
    parts = [f"({md(d)} = {k} AND year({d}) >= {y})" for k, y in fixed]
    for k, y in moving:
        for step, dow in (("+ 1", 5), ("- 1", 1)):
            x = f"({d} {step})"
            parts.append(f"(isodow({d}) = {dow} AND {md(x)} = {k} AND year({x}) >= {y})")
    for lo, hi, dow in ((115, 121, 1), (215, 221, 1), (525, 531, 1), (901, 907, 1), (1008, 1014, 1), (1122, 1128, 4), (1123, 1129, 5)):
        parts.append(f"({md(d)} BETWEEN {lo} AND {hi} AND isodow({d}) = {dow})")
    parts.append(f"{d} + 2 IN (SELECT easter FROM easters)")
    return "(" + " OR ".join(parts) + ")"


# Easter by table lookup of the ecclesiastical full moon, independent of the expression under test.
EASTERS = """easters AS (
    SELECT CAST(e AS DATE) AS easter FROM (
        SELECT y, max(m) FILTER (WHERE m IS NOT NULL) AS full_moon FROM (
            SELECT y, make_date(y, 3, 21) + CAST(((19 * (y % 19) + y // 100 - y // 100 // 4 - (8 * (y // 100) + 13) // 25 + 15) % 30) AS INT)
                   - CAST(CASE WHEN ((19 * (y % 19) + y // 100 - y // 100 // 4 - (8 * (y // 100) + 13) // 25 + 15) % 30) = 29
                          OR (((19 * (y % 19) + y // 100 - y // 100 // 4 - (8 * (y // 100) + 13) // 25 + 15) % 30) = 28 AND y % 19 > 10) THEN 1 ELSE 0 END AS INT) AS m
            FROM (SELECT CAST(unnest(generate_series(1990, 2031)) AS INT) AS y)) GROUP BY y) f,
        LATERAL (SELECT f.full_moon + CAST(7 - isodow(f.full_moon) + CASE WHEN isodow(f.full_moon) = 7 THEN 7 ELSE 0 END AS INT) AS e))"""


@query("calendar_features", """
    SELECT utc_ts, location, CAST(isodow(local_ts) - 1 AS INT) AS day_of_week, CAST(hour(local_ts) + 1 AS INT) AS end_of_hour,
           isodow(local_ts) >= 6 AS is_weekend FROM spread""", "spread")
def calendar_features(b):
    return calendar.calendar_features(b.spread).select("utc_ts", "location", "day_of_week", "end_of_hour", "is_weekend")


@query("holiday_flag", f"""
    SELECT o_orderkey, {holiday_sql('CAST(o_orderdate AS DATE)')} AS is_holiday FROM orders""", ctes=EASTERS)
def holiday_flag(b):
    return b.table("orders").select("o_orderkey", calendar.is_holiday(F.to_date("o_orderdate")).alias("is_holiday"))


_CAL = EASTERS + f""",
    yrs AS (SELECT min(year(utc_ts)) - 1 AS lo, max(year(utc_ts)) + 1 AS hi FROM daily),
    hol AS (SELECT day FROM (SELECT CAST(unnest(generate_series(CAST(make_date(lo, 1, 1) AS TIMESTAMP), CAST(make_date(hi, 12, 31) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM yrs)
            WHERE {holiday_sql('day')}),
    dist AS (SELECT utc_ts, location, CAST(utc_ts AS DATE) IN (SELECT day FROM hol) AS etf_is_federal_holiday,
                    coalesce((SELECT min(day) FROM hol WHERE day > CAST(utc_ts AS DATE)) - CAST(utc_ts AS DATE), 365) AS d_to,
                    coalesce(CAST(utc_ts AS DATE) - (SELECT max(day) FROM hol WHERE day < CAST(utc_ts AS DATE)), 365) AS d_from FROM daily)"""


@query("holiday_distance", """
    SELECT utc_ts, location, etf_is_federal_holiday, CAST(d_to AS INT) AS etf_days_to_holiday, CAST(d_from AS INT) AS etf_days_from_holiday FROM dist""",
       "daily", _CAL)
def holiday_distance(b):
    return calendar.holiday_features(b.daily).select(
        "utc_ts", "location", "etf_is_federal_holiday", "etf_days_to_holiday", "etf_days_from_holiday")


_MAJOR = """month(utc_ts) * 100 + day(utc_ts) IN (101, 119, 704, 1224, 1225, 1226)
             OR (isodow(utc_ts) = 5 AND month(utc_ts + INTERVAL 1 DAY) * 100 + day(utc_ts + INTERVAL 1 DAY) IN (101, 704, 1225))
             OR (isodow(utc_ts) = 1 AND month(utc_ts - INTERVAL 1 DAY) * 100 + day(utc_ts - INTERVAL 1 DAY) IN (101, 704, 1225))
             OR month(utc_ts) * 100 + day(utc_ts) = 302
             OR (month(utc_ts) = 5 AND day(utc_ts) >= 25 AND isodow(utc_ts) = 1) OR (month(utc_ts) = 9 AND day(utc_ts) <= 7 AND isodow(utc_ts) = 1)
             OR (month(utc_ts) = 11 AND ((day(utc_ts) BETWEEN 22 AND 28 AND isodow(utc_ts) = 4) OR (day(utc_ts) BETWEEN 23 AND 29 AND isodow(utc_ts) = 5)))"""


@query("holiday_proximity", f"""
    SELECT utc_ts, location, d_to <= 1 AND d_to > 0 AS etf_is_pre_holiday, d_from <= 1 AND d_from > 0 AS etf_is_post_holiday,
           d_to <= 3 OR d_from <= 3 AS etf_is_holiday_week,
           {_MAJOR}
           AS etf_is_major_holiday FROM dist""", "daily", _CAL)
def holiday_proximity(b):
    return calendar.holiday_features(b.daily).select(
        "utc_ts", "location", "etf_is_pre_holiday", "etf_is_post_holiday", "etf_is_holiday_week", "etf_is_major_holiday")


@query("lag_rows", "SELECT utc_ts, location, " + ", ".join(
    f"{r6(f'lag(dart_slt, {k}) OVER w')} AS dart_slt_lag_{k}hr" for k in (24, 25, 26, 168)) + f" FROM spread WINDOW w AS ({PT} ORDER BY utc_ts)", "spread")
def lag_rows(b):
    out = lags.lag_rows(b.spread, "dart_slt", [24, 25, 26, 168])
    return out.select("utc_ts", "location", *[rnd(f"dart_slt_lag_{k}hr").alias(f"dart_slt_lag_{k}hr") for k in (24, 25, 26, 168)])


@query("rolling_rows_shifted", "SELECT utc_ts, location, " + ", ".join(
    f"{r6(f'avg(dart_slt) OVER w{n}')} AS dart_slt_roll_mean_{n}hr, {r6(f'stddev_samp(dart_slt) OVER w{n}')} AS dart_slt_roll_sdev_{n}hr" for n in (24, 168))
    + f""" FROM spread WINDOW w24 AS ({PT} ORDER BY utc_ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING),
           w168 AS ({PT} ORDER BY utc_ts ROWS BETWEEN 191 PRECEDING AND 24 PRECEDING)""", "spread")
def rolling_rows_shifted(b):
    out = lags.rolling_rows_shifted(b.spread, "dart_slt", [24, 168])
    return out.select("utc_ts", "location", *[rnd(c).alias(c) for c in out.columns if "_roll_" in c])


def _lag_join(k: int) -> str:
    return f"LEFT JOIN spread l{k} ON l{k}.location = s.location AND l{k}.location_type = s.location_type AND l{k}.utc_ts = s.utc_ts - INTERVAL {k + 24} HOUR"


@query("lag_exact_time", "SELECT s.utc_ts, s.location, " + ", ".join(f"{r6(f'l{k}.dart_slt')} AS dart_slt_lag_{k}hr" for k in lags.LAG_HOURS)
       + " FROM spread s " + " ".join(_lag_join(k) for k in lags.LAG_HOURS), "spread")
def lag_exact_time(b):
    out = lags.history_features(b.spread, rolls=[])
    return out.select("utc_ts", "location", *[rnd(c).alias(c) for c in out.columns if "_lag_" in c])


def _roll_cols(n: int) -> str:
    d = f"s.utc_ts - v.utc_ts BETWEEN INTERVAL 2 DAY AND INTERVAL {n + 1} DAY"
    full = f"count(*) FILTER ({d}) = count(v.dart_slt) FILTER ({d})"
    return (f"{r6(f'CASE WHEN {full} THEN avg(v.dart_slt) FILTER ({d}) END')} AS dart_slt_roll_mean_{n * 24}hr, "
            f"{r6(f'CASE WHEN {full} THEN stddev_pop(v.dart_slt) FILTER ({d}) END')} AS dart_slt_roll_sdev_{n * 24}hr")


_ROLL = "SELECT s.utc_ts, s.location, " + ", ".join(_roll_cols(n) for n in lags.ROLL_DAYS) + """
    FROM spread s LEFT JOIN spread v ON v.location = s.location AND v.location_type = s.location_type AND hour(v.utc_ts) = hour(s.utc_ts)
    GROUP BY 1, 2"""


@query("rolling_same_hour", _ROLL, "spread")
def rolling_same_hour(b):
    out = lags.history_features(b.spread, lags=[])
    return out.select("utc_ts", "location", *[rnd(c).alias(c) for c in out.columns if "_roll_" in c])


@query("leakage_audit", """
    SELECT location, within_cutoff, CAST(count(*) AS BIGINT) AS n_rows FROM (
        SELECT location, date_trunc('day', utc_ts) - INTERVAL 25 HOUR >= utc_ts - INTERVAL 48 HOUR AS within_cutoff FROM spread) GROUP BY 1, 2""", "spread")
def leakage_audit(b):
    return lags.leakage_audit(b.spread).groupBy("location", "within_cutoff").agg(F.count("*").alias("n_rows"))


_LATEST = """latest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utc_ts, location ORDER BY posted_datetime DESC, event_id) AS rn
                   FROM vint WHERE CAST(posted_datetime AS DATE) <= CAST(utc_ts AS DATE) - 1) WHERE rn = 1),
    wide AS (SELECT utc_ts, """ + ", ".join(f"max(value) FILTER (location = '{z}') AS load_forecast_{z}" for z in ZONES) + " FROM latest GROUP BY 1)"


@query("latest_vintage", "SELECT utc_ts, location, posted_datetime, value FROM latest", "vint", _LATEST)
def latest_vintage(b):
    return vintage.latest_vintage(b.forecast_vintage, "value", tie="event_id")


@query("vintage_pivot", "SELECT * FROM wide", "vint", _LATEST)
def vintage_pivot(b):
    return vintage.vintage_wide(b.forecast_vintage, "value", ZONES, "load_forecast_", tie="event_id")


_J = ", ".join(f"w.load_forecast_{z}" for z in ZONES)


@query("join_forecasts", f"SELECT s.utc_ts, s.location, s.dart, {_J} FROM spread s LEFT JOIN wide w ON s.utc_ts = w.utc_ts", "spread vint", _LATEST)
def join_forecasts(b):
    wide = vintage.vintage_wide(b.forecast_vintage, "value", ZONES, "load_forecast_", tie="event_id")
    return b.spread.select("utc_ts", "location", "dart").join(wide, "utc_ts", "left")


@query("join_audit", " UNION ALL ".join(f"""
    SELECT 'load_forecast_{z}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(load_forecast_{z} IS NULL) AS BIGINT) AS n_null,
           min(load_forecast_{z}) AS min_value, max(load_forecast_{z}) AS max_value, {r6(f'avg(load_forecast_{z})')} AS mean_value,
           {r6(f'count_if(load_forecast_{z} IS NULL) / count(*)')} AS null_share, count(load_forecast_{z}) = 0 AS all_null
    FROM spread s LEFT JOIN wide w ON s.utc_ts = w.utc_ts""" for z in ZONES), "spread vint", _LATEST)
def join_audit(b):
    out = vintage.join_audit(join_forecasts(b), [f"load_forecast_{z}" for z in ZONES])
    return out.withColumn("mean_value", rnd("mean_value")).withColumn("null_share", rnd("null_share"))


_SLT = ", ".join(f"{r6(slt(f'load_forecast_{z}'))} AS load_forecast_{z}_slt" for z in ZONES)


@query("forecast_slt", f"SELECT utc_ts, {_SLT} FROM wide", "vint", _LATEST)
def forecast_slt(b):
    wide = vintage.vintage_wide(b.forecast_vintage, "value", ZONES, "load_forecast_", tie="event_id")
    out = vintage.with_slt(wide, [f"load_forecast_{z}" for z in ZONES])
    return out.select("utc_ts", *[rnd(c).alias(c) for c in out.columns if c.endswith("_slt")])


@query("forecast_features", f"SELECT s.utc_ts, s.location, {_J}, {_SLT} FROM spread s LEFT JOIN wide w ON s.utc_ts = w.utc_ts", "spread vint", _LATEST)
def forecast_features(b):
    f = _forecast(b)
    out = vintage.forecast_features(b.spread.select("utc_ts", "location"), f.table, f.value, f.zones, f.prefix, f.tie)
    return out.select("utc_ts", "location", *[f"load_forecast_{z}" for z in ZONES], *[rnd(f"load_forecast_{z}_slt").alias(f"load_forecast_{z}_slt") for z in ZONES])


def _cyc(expr: str, period: str, name: str) -> str:
    return f"{r6(f'sin(2 * pi() * {expr} / {period})')} AS {name}_sin, {r6(f'cos(2 * pi() * {expr} / {period})')} AS {name}_cos"


_CYC = ", ".join([_cyc("hour_local", "24", "etf_hour"), _cyc("(isodow(local_ts) - 1)", "7", "etf_dow"), _cyc("dayofyear(utc_ts)", "365.25", "etf_doy"),
                  _cyc("month(utc_ts)", "12", "etf_month"), _cyc("week(utc_ts)", "52", "etf_woy")])


@query("cyclical_features", f"SELECT utc_ts, location, {_CYC} FROM spread", "spread")
def cyclical_features(b):
    c = calendar.calendar_features(b.spread).select("utc_ts", "location", *calendar.cyclical_columns())
    return c.select("utc_ts", "location", *[rnd(x).alias(x) for x in c.columns if x.startswith("etf_")])


@query("label_encode", """
    SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE) AS o_orderstatus_le,
           CAST(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS DOUBLE) AS big_le FROM orders""")
def label_encode(b):
    o = b.table("orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 250000).alias("big"))
    return encode.label_encode(encode.label_encode(o, "o_orderstatus"), "big").select("o_orderkey", "o_orderstatus_le", "big_le")


@query("one_hot_dow", "SELECT o_orderkey, " + ", ".join(f"CAST(isodow(o_orderdate) = {d + 1} AS INT) AS day_of_week_{d}" for d in range(7)) + " FROM orders")
def one_hot_dow(b):
    return encode.one_hot(b.table("orders").select("o_orderkey", F.weekday("o_orderdate").alias("day_of_week")))


_Z = ["rt_spp_price", "dam_spp_price", "dart_slt"]


@query("zscore_by_point", "SELECT utc_ts, location, " + ", ".join(
    f"{r6(f'({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1 END')} AS {c}_z" for c in _Z)
    + f" FROM spread WINDOW w AS ({PT})", "spread")
def zscore_by_point(b):
    out = encode.zscore(b.spread, _Z)
    return out.select("utc_ts", "location", *[rnd(f"{c}_z").alias(f"{c}_z") for c in _Z])


@query("pre_z_stats", " UNION ALL ".join(f"""
    SELECT location, location_type, '{c}' AS feature, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max
    FROM spread GROUP BY 1, 2""" for c in _Z), "spread")
def pre_z_stats(b):
    out = encode.column_stats(b.spread, _Z)
    return out.select("location", "location_type", "feature", *[rnd(c).alias(c) for c in ("mean", "std", "min", "max")])


def uniform_sql(key: str, stream: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':' || CAST({stream} AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}.0::DOUBLE)"


_NOISE = ["l_quantity", "l_discount", "l_tax", "p_retailprice"]


def normal_sql(key: str, stream: int) -> str:
    u1, u2 = uniform_sql(key, str(2 * stream)), uniform_sql(key, str(2 * stream + 1))
    return f"sqrt(-2.0 * ln(greatest({u1}, 1e-15))) * cos({u2} * 2 * pi())"


@query("noise_twin", "SELECT end_hour, l_orderkey, l_linenumber, " + ", ".join(
    f"{r6(f'{c}_n01')} AS {c}_n01, {r6(f'({c}_n01 - avg({c}_n01) OVER w) / stddev_pop({c}_n01) OVER w', 5)} AS {c}_n01_z" for c in _NOISE)
    + " FROM noisy WINDOW w AS (PARTITION BY end_hour)", "feats",
    "noisy AS (SELECT end_hour, l_orderkey, l_linenumber, " + ", ".join(f"{normal_sql('l_orderkey * 8 + l_linenumber', i)} AS {c}_n01" for i, c in enumerate(_NOISE)) + " FROM feats)")
def noise_twin(b):
    f = b.features_by_hour.select("end_hour", "l_orderkey", "l_linenumber", *_NOISE)
    out = encode.noise_twin(f, _NOISE, F.col("l_orderkey") * 8 + F.col("l_linenumber"), ["end_hour"])
    return out.select("end_hour", "l_orderkey", "l_linenumber", *[rnd(f"{c}_n01").alias(f"{c}_n01") for c in _NOISE],
                      *[rnd(f"{c}_n01_z", 5).alias(f"{c}_n01_z") for c in _NOISE])


def _study(b):
    return build_study(b.rt_hourly, b.dam_hourly, [_forecast(b)], with_z=False)


_HIST = [f"dart_slt_lag_{k}hr" for k in lags.LAG_HOURS] + [f"dart_slt_roll_{m}_{n * 24}hr" for n in lags.ROLL_DAYS for m in ("mean", "sdev")]
_HISTSQL = _LATEST + ", lagd AS (SELECT s.utc_ts, s.location, " + ", ".join(f"l{k}.dart_slt AS dart_slt_lag_{k}hr" for k in lags.LAG_HOURS) \
    + " FROM spread s " + " ".join(_lag_join(k) for k in lags.LAG_HOURS) + "), rolld AS (" + _ROLL + f"""),
    hist AS (SELECT s.utc_ts, s.location, s.location_type, s.dart_slt, {', '.join(_HIST)}, {_J}
             FROM spread s JOIN lagd USING (utc_ts, location) JOIN rolld USING (utc_ts, location) LEFT JOIN wide w ON s.utc_ts = w.utc_ts)"""
_ALLF = _HIST + [f"load_forecast_{z}" for z in ZONES]
_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in _ALLF)


@query("finalize_dataset", "SELECT utc_ts, location, " + ", ".join(f"{r6(c)} AS {c}" for c in ["dart_slt", *_ALLF])
       + f" FROM hist WHERE dart_slt IS NOT NULL AND {_PRESENT}", "spread vint", _HISTSQL)
def finalize_dataset(b):
    out = finalize_study(_study(b))
    return out.select("utc_ts", "location", *[rnd(c).alias(c) for c in ["dart_slt", *_ALLF]])


@query("cleaning_summary", f"""
    SELECT location, location_type, CAST(count(*) AS BIGINT) AS rows_before, CAST(count(dart_slt) AS BIGINT) AS rows_with_target,
           CAST(count_if(dart_slt IS NOT NULL AND {_PRESENT}) AS BIGINT) AS rows_after,
           {r6(f'100.0 * (count(*) - count_if(dart_slt IS NOT NULL AND {_PRESENT})) / count(*)')} AS pct_removed
    FROM hist GROUP BY 1, 2""", "spread vint", _HISTSQL)
def cleaning_summary(b):
    s = _study(b)
    return encode.cleaning_summary(s, "dart_slt", encode.feature_columns(s.columns)).withColumn("pct_removed", rnd("pct_removed"))


# Holiday columns of the days of the spread rows.
_HOLS = EASTERS + f""",
    yrs AS (SELECT min(year(utc_ts)) - 1 AS lo, max(year(utc_ts)) + 1 AS hi FROM spread),
    hol AS (SELECT day FROM (SELECT CAST(unnest(generate_series(CAST(make_date(lo, 1, 1) AS TIMESTAMP), CAST(make_date(hi, 12, 31) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM yrs)
            WHERE {holiday_sql('day')}),
    hdist AS (SELECT d, {_MAJOR} AS major, d IN (SELECT day FROM hol) AS federal, coalesce((SELECT min(day) FROM hol WHERE day > d) - d, 365) AS d_to,
                     coalesce(d - (SELECT max(day) FROM hol WHERE day < d), 365) AS d_from FROM (SELECT DISTINCT CAST(utc_ts AS DATE) AS d, date_trunc('day', utc_ts) AS utc_ts FROM spread)),
    hdays AS (SELECT d, CAST(CAST(federal AS INT) AS DOUBLE) AS etf_is_federal_holiday, CAST(CAST(major AS INT) AS DOUBLE) AS etf_is_major_holiday, CAST(d_to AS DOUBLE) AS etf_days_to_holiday,
                     CAST(d_from AS DOUBLE) AS etf_days_from_holiday, CAST(CAST(d_to <= 1 AND d_to > 0 AS INT) AS DOUBLE) AS etf_is_pre_holiday,
                     CAST(CAST(d_from <= 1 AND d_from > 0 AS INT) AS DOUBLE) AS etf_is_post_holiday, CAST(CAST(d_to <= 3 OR d_from <= 3 AS INT) AS DOUBLE) AS etf_is_holiday_week FROM hdist)"""
_HCOLS = ", ".join(f"etf_{c}" for c in ("is_federal_holiday", "is_major_holiday", "days_to_holiday", "days_from_holiday", "is_pre_holiday", "is_post_holiday", "is_holiday_week"))
_READY = f"FROM (SELECT h.*, s.local_ts, s.hour_local, {_HCOLS} FROM hist h JOIN spread s USING (utc_ts, location) JOIN hdays ON hdays.d = CAST(h.utc_ts AS DATE))"
_METAS = "utc_ts, local_ts, CAST(hour(local_ts) + 1 AS INT) AS end_of_hour, location, location_type"


def _rounded_ready(out):
    return out.select(*[c if c in encode.META else rnd(c).alias(c) for c in out.columns])


@query("model_ready", f"SELECT {_METAS}, " + ", ".join(f"{r6(c)} AS {c}" for c in ["dart_slt", *_HIST]) + f", {_SLT}, {_CYC}, {_HCOLS} {_READY}", "spread vint", _HISTSQL + ", " + _HOLS)
def model_ready(b):
    return _rounded_ready(encode.model_ready(_study(b)))


@query("model_ready_no_history", f"SELECT {_METAS}, {r6('dart_slt')} AS dart_slt, {_SLT}, {_CYC}, {_HCOLS} {_READY}", "spread vint", _HISTSQL + ", " + _HOLS)
def model_ready_no_history(b):
    """The feature list of runs that leave the target's own past out."""
    return _rounded_ready(encode.model_ready(_study(b), history=False))


_ZED = [c for c in _HIST if "_lag_" in c] + [f"load_forecast_{z}_slt" for z in ZONES]


@query("study_z_scores", "SELECT utc_ts, location, " + ", ".join(
    f"{r6(f'({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1 END', 5)} AS {c}_z" for c in _ZED)
    + f" FROM (SELECT utc_ts, location, location_type, {', '.join(c for c in _HIST if "_lag_" in c)}, {', '.join(f'{slt(f"load_forecast_{z}")} AS load_forecast_{z}_slt' for z in ZONES)} FROM hist) WINDOW w AS (PARTITION BY location, location_type)", "spread vint", _HISTSQL)
def study_z_scores(b):
    """The study with its z-score columns: lags and forecasts scaled per settlement point."""
    s = build_study(b.rt_hourly, b.dam_hourly, [_forecast(b)])
    return s.select("utc_ts", "location", *[rnd(f"{c}_z", 5).alias(f"{c}_z") for c in _ZED])


@query("feature_completeness", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n_present, CAST(count(*) AS BIGINT) AS n_rows, {r6(f'100.0 * count({c}) / count(*)')} AS pct_present FROM hist""" for c in _ALLF),
       "spread vint", _HISTSQL)
def feature_completeness(b):
    return encode.feature_completeness(_study(b), _ALLF).withColumn("pct_present", rnd("pct_present"))
