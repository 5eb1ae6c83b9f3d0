"""Queries that write files and read them back: sources, checked layers, incremental sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.catalog.oracle_parts import r6
from spreadlab.catalog.registry import query
from spreadlab.functions.columns import rnd
from spreadlab.plans import landing
from spreadlab.sources import files, payload, tables
from spreadlab.sources.contracts import PREDICTION_COLUMNS

_DAY = "strftime(utc_ts, '%Y-%m-%d')"


@query("csv_scan", """
    SELECT 'broken' AS kind, CAST(count_if(k % 10 = 3) AS BIGINT) AS n_rows, CAST(0 AS DOUBLE) AS total FROM ev
    UNION ALL SELECT 'sound', CAST(count_if(k % 10 <> 3) AS BIGINT), round(sum(value) FILTER (k % 10 <> 3), 2) + CAST(0 AS DOUBLE) FROM ev""", "ev")
def csv_scan(b):
    """Header CSV read under a declared schema; records whose number does not parse are kept apart and counted."""
    path = files.scratch_path(b.spark, "csv")
    text = F.when(F.col("k") % 10 == 3, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    b.events.select("event_id", text.alias("value"), "event_type").write.option("header", True).csv(f"{path}/events_1")
    rows = files.scan_csv(b.spark, files.the_one(b.spark, f"{path}/events_*"), "event_id bigint, value double, event_type string")
    kind = F.when(F.col(files.CORRUPT).isNull(), "sound").otherwise("broken")
    whole = F.round(F.coalesce(F.sum(F.when(F.col(files.CORRUPT).isNull(), F.col("value"))), F.lit(0.0)), 2) + F.lit(0.0)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_rows"), whole.alias("total"))


_TYPES = {"event_id": "INTEGER", "value": "DECIMAL", "event_type": "VARCHAR", "k": "INTEGER"}


@query("payload_files", "SELECT event_id, value, event_type, CAST(k AS BIGINT) AS k FROM ev", "ev")
def payload_files(b):
    """JSON documents with a list of fields and positional rows, written per user and decoded by each document's own names."""
    path = files.scratch_path(b.spark, "payload")
    names = list(_TYPES)
    field = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("dataType")) for n, t in _TYPES.items()])
    flip = F.col("part") % 2 == 1
    docs = b.events.withColumn("part", F.col("user_id") % 8).groupBy("part").agg(F.collect_list(F.array(*[F.col(n).cast("string") for n in names])).alias("rows"))
    docs = docs.select(
        F.lit("m").alias("_meta"), F.when(flip, F.reverse(field)).otherwise(field).alias("fields"),
        F.when(flip, F.transform("rows", F.reverse)).otherwise(F.col("rows")).alias("data"))
    docs.write.option("maxRecordsPerFile", 1).json(path)  # a document is a file
    return payload.read_payloads(b.spark, path, [{"name": n, "dataType": t} for n, t in _TYPES.items()])


@query("record_files", "SELECT event_id, event_type, value FROM ev", "ev")
def record_files(b):
    """JSON documents with named members, one of them with no records: it adds no row."""
    path = files.scratch_path(b.spark, "records")
    docs = b.events.withColumn("part", F.col("user_id") % 8).groupBy("part").agg(F.collect_list(F.struct("event_id", "event_type", "value")).alias("data"))
    none = docs.select(F.filter("data", lambda x: F.lit(False)).alias("data")).limit(1)
    docs.select("data").unionByName(none).select(F.lit("m").alias("_meta"), "data").write.option("maxRecordsPerFile", 1).json(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    return payload.read_records(b.spark, path, schema)


_STUDY = {"rt_spp_transformed": "rt_hourly", "dam_spp_clean": "dam_hourly", "dam_system_lambda_clean": "dam_hourly", "load_forecast_clean": "forecast_vintage",
          "wind_power_gen_clean": "forecast_vintage", "solar_power_gen_clean": "forecast_vintage"}
_PART = {"rt_hourly": "rth", "dam_hourly": "damh", "forecast_vintage": "vint"}


@query("study_inputs", " UNION ALL ".join(
    f"SELECT '{n.removesuffix('_clean').removesuffix('_transformed')}' AS input, CAST(count(*) AS BIGINT) AS n_rows, min(utc_ts) AS first_ts, max(utc_ts) AS last_ts FROM {_PART[s]}" for n, s in _STUDY.items()), "rth damh vint")
def study_inputs(b):
    """The six study inputs written side by side and found again, each exactly once."""
    path = files.scratch_path(b.spark, "study")
    for name, source in _STUDY.items():
        getattr(b, source).write.parquet(f"{path}/{name}")
    found = files.scan_study(b.spark, path)
    return tables.union_all([d.agg(F.count("*").alias("n_rows"), F.min("utc_ts").alias("first_ts"), F.max("utc_ts").alias("last_ts")).withColumn("input", F.lit(n)) for n, d in found.items()])


@query("model_input_file", "SELECT utc_ts, location, dart FROM spread WHERE location = 'LZ_CLICK'", "spread")
def model_input_file(b):
    """The dataset of one point, from the one folder that bears its name."""
    path = files.scratch_path(b.spark, "final")
    for point in ("LZ_CLICK", "LZ_VIEW"):
        b.spread.where(F.col("location") == point).write.parquet(f"{path}/final_{point}_LZ")
    return files.scan_point(b.spark, path, "LZ_CLICK_LZ").select("utc_ts", "location", "dart")


@query("posted_extracts", f"""
    SELECT source, strftime(posted_datetime, '%Y-%m-%d') AS extract_date, CAST(count(*) AS BIGINT) AS n_rows, {r6('sum(value)', 3)} AS total
    FROM vint, (SELECT unnest(['load', 'wind', 'solar']) AS source) GROUP BY 1, 2""", "vint")
def posted_extracts(b):
    """Load, wind and solar forecasts under a directory per posted date, read back."""
    path, out = files.scratch_path(b.spark, "posted"), []
    for name in ("load", "wind", "solar"):
        tables.write_daily(b.forecast_vintage, F.to_date("posted_datetime"), f"{path}/{name}")
        back = b.spark.read.parquet(f"{path}/{name}").withColumn("source", F.lit(name))
        out.append(back.groupBy("source", F.col("extract_date").cast("string").alias("extract_date")).agg(F.count("*").alias("n_rows"), rnd(F.sum("value"), 3).alias("total")))
    return tables.union_all(out)


@query("daily_rewrite", f"""
    SELECT {_DAY} AS extract_date, CAST(count(*) AS BIGINT) AS n_rows, {r6(f"sum(CASE WHEN {_DAY} = (SELECT max({_DAY}) FROM rth) THEN 2 * price_mean ELSE price_mean END)", 2)} AS total FROM rth GROUP BY 1""", "rth")
def daily_rewrite(b):
    """All dates written, then the last one again with other values: only its directory changes."""
    path = files.scratch_path(b.spark, "dates")
    rows = b.rt_hourly
    landing.replace_dates(rows, F.to_date("utc_ts"), path)
    last = rows.agg(F.max(F.to_date("utc_ts"))).first()[0]
    landing.replace_dates(rows.where(F.to_date("utc_ts") == F.lit(last)).withColumn("price_mean", 2 * F.col("price_mean")), F.to_date("utc_ts"), path)
    back = b.spark.read.parquet(path)
    return back.groupBy(F.col("extract_date").cast("string").alias("extract_date")).agg(F.count("*").alias("n_rows"), rnd(F.sum("price_mean"), 2).alias("total"))


@query("dedup_keep_last", """
    SELECT utc_ts, location, posted_datetime, event_id, value, CAST(n - 1 AS BIGINT) AS n_removed FROM (
        SELECT *, row_number() OVER (PARTITION BY utc_ts, location ORDER BY posted_datetime DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY utc_ts, location) AS n FROM vint) WHERE r = 1""", "vint")
def dedup_keep_last(b):
    """The last posted row of every delivery hour and location, with the number of rows it replaces."""
    return landing.keep_last(b.forecast_vintage, ["utc_ts", "location"], ["posted_datetime", "event_id"])


@query("strategy_files", f"""
    SELECT settlement_point, CAST(count(*) AS BIGINT) AS n_trades, CAST(sum(predicted_dart_slt) AS BIGINT) AS n_long, {r6('sum(prediction_confidence)', 4)} AS confidence,
           CAST(count(*) AS BIGINT) AS summary_trades FROM pred GROUP BY 1""", "pred")
def strategy_files(b):
    """Trades as CSV and their summary as JSON, read back and put side by side."""
    path = files.scratch_path(b.spark, "strategy")
    trades = b.predictions.select("settlement_point", "utc_ts", *[c for c in PREDICTION_COLUMNS if c != "utc_ts"], "prediction_confidence")
    landing.write_strategy(trades, trades.groupBy("settlement_point").agg(F.count("*").alias("n_trades")), path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trades.schema)
    back, summary = landing.read_strategy(b.spark, schema, "settlement_point string, n_trades bigint", path)
    found = back.groupBy("settlement_point").agg(F.count("*").alias("n_trades"), F.sum("predicted_dart_slt").cast("long").alias("n_long"), rnd(F.sum("prediction_confidence"), 4).alias("confidence"))
    return found.join(summary.withColumnRenamed("n_trades", "summary_trades"), "settlement_point")
