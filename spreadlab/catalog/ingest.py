"""Queries over sources, time normalisation, cleaning, hourly bars and the target."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadlab.catalog.oracle_parts import LOCAL, r6, slt
from spreadlab.catalog.registry import query
from spreadlab.functions import timeconv as tc
from spreadlab.functions.columns import inverse_signed_log, rnd, signed_log
from spreadlab.operators import bars, clean, target
from spreadlab.plans import etl
from spreadlab.sources import files, payload, tables

_UTC_FIRST = "timezone('UTC', timezone('America/Chicago', {0}))"


def utc_sql(local: str, hour: str, flag: str) -> str:
    """The oracle engine resolves a repeated hour to standard time, so the first pass needs -1 h."""
    u = _UTC_FIRST.format(local)
    back = LOCAL.format(f"({u} - INTERVAL 1 HOUR)")
    here = LOCAL.format(u)
    return (
        f"(CASE WHEN {here} <> {local} THEN date_trunc('hour', {u}) "
        f"WHEN {back} = {local} AND NOT ({hour} = 1 AND coalesce({flag}, FALSE)) THEN {u} - INTERVAL 1 HOUR ELSE {u} END)"
    )


FIELDS = [
    {"name": "flag", "dataType": "BOOLEAN"}, {"name": "qty", "dataType": "INTEGER"},
    {"name": "price", "dataType": "DECIMAL"}, {"name": "day", "dataType": "DATE"},
    {"name": "label", "dataType": "VARCHAR"}, {"name": "other", "dataType": "GEOMETRY"},
]


@query("payload_typed_cast", """
    SELECT CASE WHEN o_orderstatus = 'F' THEN TRUE WHEN o_orderstatus = 'O' THEN FALSE END AS flag,
           CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderkey END AS qty, o_totalprice AS price,
           o_orderdate AS day, o_orderpriority AS label, o_orderstatus AS other FROM orders""")
def payload_typed_cast(b):
    o = b.table("orders")
    names, forward = [f["name"] for f in FIELDS], F.col("o_orderkey") % 2 == 0
    text = o.select(forward.alias("forward"), F.array(
        F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("maybe"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string")),
        F.col("o_totalprice").cast("string"), F.col("o_orderdate").cast("string"),
        F.col("o_orderpriority"), F.col("o_orderstatus"),
    ).alias("row"))
    either = lambda a: F.when(F.col("forward"), a).otherwise(F.reverse(a))  # half of the documents list their fields the other way round
    text = text.select(either(F.array(*map(F.lit, names))).alias("names"), either(F.col("row")).alias("row"))
    return payload.cast_rows(text, "row", FIELDS, "names")


@query("scan_events", "SELECT event_id, ts, user_id, event_type, value, k FROM ev", "ev")
def scan_events(b):
    return b.events


@query("predictions_contract", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) > 0 AS non_empty,
           CAST(count_if(utc_ts IS NULL) AS BIGINT) AS null_utc_ts, CAST(count_if(actual_dart_slt IS NULL) AS BIGINT) AS null_actual_dart_slt,
           CAST(count_if(predicted_dart_slt IS NULL) AS BIGINT) AS null_predicted_dart_slt, CAST(count_if(end_hour IS NULL) AS BIGINT) AS null_end_hour
    FROM pred""", "pred")
def predictions_contract(b):
    from spreadlab.sources.contracts import PREDICTION_COLUMNS, require_columns

    p = require_columns(b.predictions, PREDICTION_COLUMNS)
    return p.agg(
        F.count("*").alias("n_rows"), (F.count("*") > 0).alias("non_empty"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in PREDICTION_COLUMNS],
    )


@query("union_sources", """
    SELECT utc_ts, location, round(price, 6) AS price, 'rt' AS source FROM rt15 UNION ALL SELECT utc_ts, location, price, 'dam' FROM damh
    """, "rt15 damh", ctes="")
def union_sources(b):
    rt = b.rt_15m.select("utc_ts", "location", rnd("price").alias("price"), F.lit("rt").alias("source"))
    dam = b.dam_hourly.select("utc_ts", "location", rnd("price").alias("price"), F.lit("dam").alias("source"))
    return tables.union_all([rt, dam])


@query("dedup_full_row", "SELECT DISTINCT user_id, event_type, k FROM ev", "ev")
def dedup_full_row(b):
    return tables.dedup_rows(b.events.select("user_id", "event_type", "k"))


@query("safe_identifier", """
    SELECT DISTINCT replace(replace(o_orderpriority || '_' || o_orderstatus || '(a/b)', ' ', '_'), '/', '_') AS raw_id,
           replace(replace(replace(replace(o_orderpriority || '_' || o_orderstatus || '(a/b)', ' ', '_'), '/', '_'), '(', ''), ')', '') AS safe_id,
           o_orderpriority || ' (' || o_orderstatus || ')' AS point_identifier FROM orders""")
def safe_identifier(b):
    o = b.table("orders").select("o_orderpriority", "o_orderstatus").distinct()
    kind = F.concat(F.col("o_orderstatus"), F.lit("(a/b)"))
    return o.select(
        F.regexp_replace(F.concat_ws("_", "o_orderpriority", kind), "[ /]", "_").alias("raw_id"),
        tables.safe_identifier("o_orderpriority", kind).alias("safe_id"),
        tables.point_identifier("o_orderpriority", "o_orderstatus").alias("point_identifier"),
    )


@query("hour_ending_to_start", """
    SELECT o_orderkey, hourEnding, CAST(split_part(hourEnding, ':', 1) AS INT) - 1 AS start_hour,
           CAST(o_orderkey % 24 AS INT) AS start_from_int FROM local_hours""", "local_hours")
def hour_ending_to_start(b):
    return b.local_hours.select(
        "o_orderkey", "hourEnding", tc.hour_ending_to_start("hourEnding").alias("start_hour"),
        tc.delivery_hour_to_start((F.col("o_orderkey") % 24 + 1).cast("int")).alias("start_from_int"),
    )


@query("local_to_utc_dst", f"""
    SELECT o_orderkey, local_ts, {utc_sql('local_ts', 'hour(local_ts)', 'DSTFlag')} AS utc_ts
    FROM (SELECT *, CAST(deliveryDate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) AS local_ts FROM local_hours)""", "local_hours")
def local_to_utc_dst(b):
    local = F.col("deliveryDate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    h = b.local_hours.withColumn("local_ts", local)
    return h.select("o_orderkey", "local_ts", tc.local_to_utc("local_ts", F.hour("local_ts"), "DSTFlag").alias("utc_ts"))


@query("delivery_to_utc", f"""
    SELECT o_orderkey, local_ts, {utc_sql('local_ts', 'hour(local_ts)', 'DSTFlag')} AS utc_ts
    FROM (SELECT *, CAST(deliveryDate AS TIMESTAMP) + to_hours(CAST(split_part(hourEnding, ':', 1) AS INT) - 1) AS local_ts FROM local_hours)""", "local_hours")
def delivery_to_utc(b):
    return etl.normalise_hourly(b.local_hours).select("o_orderkey", "local_ts", "utc_ts")


_RT_NORM = f"""
    rt_norm AS (
        SELECT *, base_utc + to_minutes(CAST((deliveryInterval - 1) * 15 AS INT)) AS utc_ts,
               base_local + to_minutes(CAST((deliveryInterval - 1) * 15 AS INT)) AS local_ts
        FROM (SELECT *, {utc_sql('base_local', 'hour(base_local)', 'DSTFlag')} AS base_utc
              FROM (SELECT *, CAST(deliveryDate AS TIMESTAMP) + to_hours(CAST(deliveryHour - 1 AS INT)) AS base_local FROM raw_rt)))"""


@query("interval_offset", """
    SELECT utc_ts, local_ts, deliveryInterval, settlementPoint, settlementPointPrice FROM rt_norm""", "raw_rt", _RT_NORM)
def interval_offset(b):
    return etl.normalise_rt(b.raw_rt).select("utc_ts", "local_ts", "deliveryInterval", "settlementPoint", "settlementPointPrice")


@query("posting_window_filter", """
    SELECT event_id, posted_datetime FROM vint
    WHERE posted_datetime >= date_trunc('day', posted_datetime) + INTERVAL 5 HOUR
      AND posted_datetime <= date_trunc('day', posted_datetime) + INTERVAL 6 HOUR""", "vint")
def posting_window_filter(b):
    return b.forecast_vintage.where(tc.posting_window("posted_datetime")).select("event_id", "posted_datetime")


@query("delivery_date_filter", """
    SELECT settlementPoint, deliveryHour, settlementPointPrice FROM raw_rt
    WHERE deliveryDate BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND settlementPoint = 'LZ_CLICK'""", "raw_rt")
def delivery_date_filter(b):
    return clean.keep_delivery_day(b.raw_rt, "2024-01-10", "2024-01-12", "LZ_CLICK").select(
        "settlementPoint", "deliveryHour", "settlementPointPrice")


@query("settlement_point_semi_join", """
    SELECT settlementPoint, CAST(count(*) AS BIGINT) AS n_rows FROM raw_rt
    WHERE settlementPoint IN ('LZ_CLICK', 'HB_SIGNUP') GROUP BY 1""", "raw_rt")
def settlement_point_semi_join(b):
    return clean.keep_points(b.raw_rt, "settlementPoint", ["LZ_CLICK", "HB_SIGNUP"]).groupBy("settlementPoint").agg(
        F.count("*").alias("n_rows"))


@query("date_spine", """
    SELECT strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d') AS day FROM (
        SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)""")
def date_spine(b):
    bounds = b.table("orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return tc.date_spine(bounds, "lo", "hi").select(F.col("day").cast("string").alias("day"))


@query("prefix_filter", """
    SELECT settlementPoint, CAST(count(*) AS BIGINT) AS n_rows, round(avg(settlementPointPrice), 6) AS avg_price
    FROM raw_rt WHERE settlementPoint LIKE 'LZ!_%' ESCAPE '!' OR settlementPoint LIKE 'HB!_%' ESCAPE '!' GROUP BY 1""", "raw_rt")
def prefix_filter(b):
    return clean.keep_prefixes(b.raw_rt, "settlementPoint").groupBy("settlementPoint").agg(
        F.count("*").alias("n_rows"), rnd(F.avg("settlementPointPrice")).alias("avg_price"))


@query("in_use_filter", """
    SELECT hourEnding, CAST(count(*) AS BIGINT) AS n_rows FROM raw_zones WHERE inUseFlag GROUP BY 1""", "raw_zones")
def in_use_filter(b):
    return clean.keep_flagged(b.raw_zones).groupBy("hourEnding").agg(F.count("*").alias("n_rows"))


@query("clean_rt", """
    SELECT utc_ts, local_ts, settlementPoint AS location, settlementPointType AS location_type, deliveryHour, deliveryInterval,
           settlementPointPrice AS price, DSTFlag AS dst_flag
    FROM rt_norm WHERE settlementPoint[1:3] IN ('LZ_', 'HB_')""", "raw_rt", _RT_NORM)
def clean_rt(b):
    return clean.clean_rt(etl.normalise_rt(b.raw_rt))


def _hourly_norm(src: str) -> str:
    return f"""{src}_norm AS (
        SELECT *, {utc_sql('local_ts', 'hour(local_ts)', 'DSTFlag')} AS utc_ts
        FROM (SELECT *, CAST(deliveryDate AS TIMESTAMP) + to_hours(CAST(split_part(hourEnding, ':', 1) AS INT) - 1) AS local_ts FROM {src}))"""


@query("clean_dam", f"""
    SELECT utc_ts, local_ts, settlementPoint AS location, {r6('settlementPointPrice')} AS price, DSTFlag AS dst_flag
    FROM raw_dam_norm WHERE settlementPoint[1:3] IN ('LZ_', 'HB_')""", "raw_dam", _hourly_norm("raw_dam"))
def clean_dam(b):
    return clean.clean_dam(etl.normalise_hourly(b.raw_dam)).withColumn("price", rnd("price"))


@query("clean_lambda", f"""
    SELECT utc_ts, local_ts, {r6('systemLambda')} AS price, DSTFlag AS dst_flag FROM raw_lambda_norm""",
       "raw_lambda", _hourly_norm("raw_lambda"))
def clean_lambda(b):
    return clean.clean_lambda(etl.normalise_hourly(b.raw_lambda)).withColumn("price", rnd("price"))


ZONES = ["coast", "east", "north", "west"]
_MELT = "melted AS (SELECT * FROM raw_zones UNPIVOT INCLUDE NULLS (value FOR location IN (coast, east, north, west)))"


@query("melt_zones", """
    SELECT postedDatetime, strftime(CAST(deliveryDate AS TIMESTAMP), '%Y-%m-%d') AS delivery_date, hourEnding, location, value FROM melted""",
       "raw_zones", _MELT)
def melt_zones(b):
    z = b.raw_zones.withColumn("delivery_date", F.col("deliveryDate").cast("string"))
    return clean.melt_zones(z, ["postedDatetime", "delivery_date", "hourEnding"], ZONES, "value")


@query("coerce_and_drop", f"""
    SELECT location, CAST(count(*) AS BIGINT) AS n_rows, {r6('avg(value)', 4)} AS avg_value FROM melted WHERE value IS NOT NULL GROUP BY 1""",
       "raw_zones", _MELT)
def coerce_and_drop(b):
    m = clean.melt_zones(b.raw_zones, ["hourEnding"], ZONES, "value")
    return clean.coerce_and_drop(m, "value").groupBy("location").agg(
        F.count("*").alias("n_rows"), rnd(F.avg("value"), 4).alias("avg_value"))


@query("distinct_posted_dates", """
    SELECT DISTINCT strftime(postedDatetime, '%Y-%m-%d') AS posted_date FROM raw_zones""", "raw_zones")
def distinct_posted_dates(b):
    return clean.distinct_dates(b.raw_zones, "postedDatetime").withColumn("posted_date", F.col("posted_date").cast("string"))


@query("daily_partition_extract", """
    SELECT strftime(utc_ts, '%Y-%m-%d') AS extract_date, location || ' (' || location_type || ')' AS point_identifier,
           CAST(count(*) AS BIGINT) AS n_rows, min(utc_ts) AS first_ts, max(utc_ts) AS last_ts FROM rth GROUP BY 1, 2""", "rth")
def daily_partition_extract(b):
    """Written under a directory per date and read back from there."""
    path = files.scratch_path(b.spark, "daily")
    tables.write_daily(b.rt_hourly, F.to_date("utc_ts"), path)
    return b.spark.read.parquet(path).groupBy(
        F.col("extract_date").cast("string").alias("extract_date"),
        tables.point_identifier("location", "location_type").alias("point_identifier"),
    ).agg(F.count("*").alias("n_rows"), F.min("utc_ts").alias("first_ts"), F.max("utc_ts").alias("last_ts"))


@query("validate_not_null", """
    SELECT c AS column_name, CAST(n AS BIGINT) AS n_rows, CAST(k AS BIGINT) AS n_null, k = 0 AS passed FROM (
        SELECT unnest(['utc_ts', 'location', 'dam_spp_price', 'price_std']) AS c, n, unnest(ks) AS k FROM (
            SELECT count(*) AS n, [count_if(utc_ts IS NULL), count_if(location IS NULL), count_if(dam_spp_price IS NULL), count_if(price_std IS NULL)] AS ks FROM spread))""", "spread")
def validate_not_null(b):
    return clean.validate_not_null(b.spread, ["utc_ts", "location", "dam_spp_price", "price_std"])


@query("validate_domain", """
    SELECT settlementPoint AS offender, CAST(count(*) AS BIGINT) AS n_rows FROM raw_rt
    WHERE settlementPoint[1:3] NOT IN ('LZ_', 'HB_') GROUP BY 1""", "raw_rt")
def validate_domain(b):
    return clean.validate_domain(b.raw_rt, "settlementPoint", prefixes=["LZ_", "HB_"])


@query("validate_nonempty", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(trim(coalesce(settlementPointType, '')) = '') AS BIGINT) AS n_blank,
           count(*) > 0 AND count_if(trim(coalesce(settlementPointType, '')) = '') = 0 AS passed FROM raw_rt""", "raw_rt")
def validate_nonempty(b):
    return clean.validate_nonempty(b.raw_rt, "settlementPointType")


@query("temporal_completeness", """
    SELECT strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d') AS day, CAST(hours_present AS BIGINT) AS hours_present, day > lo AND day < hi AS interior FROM (
        SELECT s.day, coalesce(h.n, 0) AS hours_present, s.lo, s.hi FROM (
            SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi
            FROM (SELECT date_trunc('day', min(utc_ts)) AS lo, date_trunc('day', max(utc_ts)) AS hi FROM vint)) s
        LEFT JOIN (SELECT CAST(utc_ts AS DATE) AS day, count(DISTINCT hour(utc_ts)) AS n FROM vint GROUP BY 1) h ON s.day = h.day)
    WHERE hours_present < 24""", "vint")
def temporal_completeness(b):
    return clean.incomplete_days(b.forecast_vintage).withColumn("day", F.col("day").cast("string"))


_COMPLETE = """
    per_day AS (SELECT location, location_type, CAST(utc_ts AS DATE) AS day, count(DISTINCT hour(utc_ts)) AS n FROM rth GROUP BY 1, 2, 3),
    span AS (SELECT location, location_type, min(day) AS lo, max(day) AS hi FROM per_day GROUP BY 1, 2),
    days AS (SELECT location, location_type, lo, hi, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span)"""


@query("temporal_completeness_by_point", """
    SELECT location, location_type, CAST(max(hi) - min(lo) + 1 AS BIGINT) AS span_days, CAST(count_if(n = 0) AS BIGINT) AS n_absent_days,
           CAST(count_if(n < 24) AS BIGINT) AS n_short_days, CAST(count_if(n < 24 AND day > lo AND day < hi) AS BIGINT) AS n_short_interior,
           count_if(n < 24 AND day > lo AND day < hi) = 0 AS complete
    FROM (SELECT d.*, coalesce(p.n, 0) AS n FROM days d LEFT JOIN per_day p USING (location, location_type, day)) GROUP BY 1, 2""", "rth", _COMPLETE)
def temporal_completeness_by_point(b):
    return clean.completeness(b.rt_hourly, ["location", "location_type"])


@query("null_profile", """
    SELECT c AS column_name, CAST(n AS BIGINT) AS n_rows, CAST(k AS BIGINT) AS n_null FROM (
        SELECT unnest(['postedDatetime','deliveryDate','hourEnding','coast','east','north','west','inUseFlag','DSTFlag']) AS c, n, unnest(ks) AS k FROM (
            SELECT count(*) AS n, [count_if(postedDatetime IS NULL), count_if(deliveryDate IS NULL), count_if(hourEnding IS NULL), count_if(coast IS NULL),
                count_if(east IS NULL), count_if(north IS NULL), count_if(west IS NULL), count_if(inUseFlag IS NULL), count_if(DSTFlag IS NULL)] AS ks
            FROM raw_zones))""", "raw_zones")
def null_profile(b):
    return clean.null_profile(b.raw_zones)


@query("table_profile", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(price IS NULL) AS BIGINT) AS n_null_cells, CAST(5 AS INT) AS n_columns, 'hour_local' AS missing_columns FROM (
        SELECT settlementPointPrice AS price FROM raw_dam WHERE settlementPoint[1:3] IN ('LZ_', 'HB_'))""", "raw_dam")
def table_profile(b):
    return clean.table_profile(clean.clean_dam(etl.normalise_hourly(b.raw_dam)))


@query("duplicate_prices", """
    SELECT utc_ts, settlementPoint AS location, CAST(count(*) AS BIGINT) AS n_rows FROM rt_norm WHERE settlementPoint[1:3] IN ('LZ_', 'HB_') GROUP BY 1, 2 HAVING count(*) > 1""", "raw_rt", _RT_NORM)
def duplicate_prices(b):
    return target.duplicate_prices(clean.clean_rt(etl.normalise_rt(b.raw_rt)))


@query("late_null_report", """
    SELECT location, location_type, CAST(count_if(dart IS NULL) AS BIGINT) AS n_null,
           CAST(count_if(dart IS NULL AND CAST(utc_ts AS DATE) - first_day >= 1) AS BIGINT) AS n_late_null
    FROM (SELECT *, min(CAST(utc_ts AS DATE)) OVER (PARTITION BY location, location_type) AS first_day FROM spread) GROUP BY 1, 2""", "spread")
def late_null_report(b):
    return clean.late_nulls(b.spread, ["location", "location_type"], "dart")


@query("hourly_price_stats", "SELECT utc_ts, local_ts, location, location_type, price_mean, price_std, CAST(hour_local AS INT) AS hour_local FROM rth", "rth")
def hourly_price_stats(b):
    return b.rt_hourly


@query("etl_rt_end_to_end", f"""
    SELECT date_trunc('hour', utc_ts) AS utc_ts, date_trunc('hour', local_ts) AS local_ts, settlementPoint AS location,
           settlementPointType AS location_type, {r6('avg(settlementPointPrice)')} AS price_mean,
           {r6('stddev_samp(settlementPointPrice)')} AS price_std, CAST(hour(date_trunc('hour', local_ts)) AS INT) AS hour_local
    FROM rt_norm WHERE settlementPoint[1:3] IN ('LZ_', 'HB_') GROUP BY 1, 2, 3, 4, 7""", "raw_rt", _RT_NORM)
def etl_rt_end_to_end(b):
    """Raw rows to the written hourly layer in one scan; keys, points and days are checked on the way, and nothing lands if one fails."""
    path = files.scratch_path(b.spark, "rt-layer")
    schema = etl.land_rt(b.raw_rt, path)
    return b.spark.read.schema(schema).parquet(path)


@query("layer_round_trip", "SELECT utc_ts, local_ts, location, location_type, price_mean, price_std, CAST(hour_local AS INT) AS hour_local FROM rth", "rth")
def layer_round_trip(b):
    """The hourly layer written by location and month, and scanned again."""
    path = files.scratch_path(b.spark, "layer")
    tables.write_layer(b.rt_hourly, path, files_per_span=2)
    return b.spark.read.schema(b.rt_hourly.schema).parquet(path)


@query("join_rt_dam", """
    SELECT utc_ts, location, location_type, rt_spp_price, dam_spp_price FROM spread""", "spread")
def join_rt_dam(b):
    return target.join_prices(b.rt_hourly, b.dam_hourly).select(
        "utc_ts", "location", "location_type", "rt_spp_price", "dam_spp_price")


@query("dart_spread", "SELECT utc_ts, location, location_type, dart FROM spread", "spread")
def dart_spread(b):
    return b.spread.select("utc_ts", "location", "location_type", "dart")


@query("signed_log", f"""
    SELECT utc_ts, location, {r6(slt('dart'))} AS slt, {r6('CASE WHEN dart <> 0 THEN ' + slt('dart') + ' END')} AS slt_no_zero FROM spread""", "spread")
def signed_log_query(b):
    return b.spread.select("utc_ts", "location", rnd(signed_log("dart")).alias("slt"),
                           rnd(signed_log("dart", ignore_zeros=True)).alias("slt_no_zero"))


@query("inverse_signed_log", f"""
    SELECT utc_ts, location, dart, {r6('sign(dart_slt) * (exp(abs(dart_slt)) - 1)')} AS back FROM spread""", "spread")
def inverse_signed_log_query(b):
    return b.spread.select("utc_ts", "location", "dart", rnd(inverse_signed_log("dart_slt")).alias("back"))


@query("dart_target", f"""
    SELECT utc_ts, local_ts, location, location_type, CAST(hour_local AS INT) AS hour_local, rt_spp_price, price_std, dam_spp_price, dart, {r6('dart_slt')} AS dart_slt FROM spread""", "spread")
def dart_target(b):
    return b.spread.withColumn("dart_slt", rnd("dart_slt"))
