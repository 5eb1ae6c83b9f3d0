"""Domain-shaped tables derived from the provided Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.functions.columns import rnd, signed_log
from spreadlab.functions.timeconv import shift_seconds, utc_to_local
from spreadlab.operators import bars, target


class Bindings:
    """Lazy access to the domain tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @property
    def raw_rt(self) -> DataFrame:
        """Quarter-hour settlement rows; event clocks play the local market clock."""
        e = self.events
        prefix = (F.when(F.col("event_type") == "error", "XX_").when(F.col("event_type") == "signup", "HB_").otherwise("LZ_"))
        return e.select(
            F.to_date("ts").alias("deliveryDate"), (F.hour("ts") + 1).alias("deliveryHour"),
            (F.floor(F.minute("ts") / 15) + 1).cast("int").alias("deliveryInterval"),
            F.concat(prefix, F.upper("event_type")).alias("settlementPoint"),
            F.when(F.col("event_type") == "signup", "HU").otherwise("LZ").alias("settlementPointType"),
            F.col("value").alias("settlementPointPrice"), (F.col("k") >= 50).alias("DSTFlag"),
        )

    @property
    def raw_dam(self) -> DataFrame:
        e = self.events
        prefix = (F.when(F.col("event_type") == "error", "XX_").when(F.col("event_type") == "signup", "HB_").otherwise("LZ_"))
        return e.groupBy(
            F.to_date("ts").alias("deliveryDate"),
            F.concat(F.lpad((F.hour("ts") + 1).cast("string"), 2, "0"), F.lit(":00")).alias("hourEnding"),
            F.concat(prefix, F.upper("event_type")).alias("settlementPoint"),
        ).agg(F.avg("k").alias("settlementPointPrice")).withColumn("DSTFlag", F.lit(False))

    @property
    def raw_lambda(self) -> DataFrame:
        return self.events.groupBy(
            F.to_date("ts").alias("deliveryDate"),
            F.concat(F.lpad((F.hour("ts") + 1).cast("string"), 2, "0"), F.lit(":00")).alias("hourEnding"),
        ).agg(F.avg("k").alias("systemLambda")).withColumn("DSTFlag", F.lit(False))

    @property
    def raw_zones(self) -> DataFrame:
        """Posted zone reports: four measures of a line item stand for four zones."""
        li = self.table("lineitem")
        return li.select(
            F.col("l_shipdate").cast("timestamp").alias("postedDatetime"),
            F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") % 4).alias("deliveryDate"),
            F.concat(F.lpad((F.col("l_orderkey") % 24 + 1).cast("string"), 2, "0"), F.lit(":00")).alias("hourEnding"),
            F.col("l_quantity").alias("coast"), F.col("l_extendedprice").alias("east"),
            F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("north"), F.col("l_tax").alias("west"),
            F.when(F.col("l_returnflag") != "R", F.col("l_linestatus") == "F").alias("inUseFlag"),
            (F.col("l_orderkey") % 2 == 0).alias("DSTFlag"),
        )

    @property
    def local_hours(self) -> DataFrame:
        return self.table("orders").select(
            "o_orderkey", F.to_date("o_orderdate").alias("deliveryDate"),
            F.concat(F.lpad((F.col("o_orderkey") % 24 + 1).cast("string"), 2, "0"), F.lit(":00")).alias("hourEnding"),
            (F.col("o_orderkey") % 2 == 0).alias("DSTFlag"),
        )

    @property
    def rt_15m(self) -> DataFrame:
        slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 900) * 900)
        return (
            self.events.groupBy(slot.alias("utc_ts"), F.concat(F.lit("LZ_"), F.upper("event_type")).alias("location"))
            .agg(F.avg("value").alias("price"))
            .select("utc_ts", utc_to_local("utc_ts").alias("local_ts"), "location", F.lit("LZ").alias("location_type"), "price")
        )

    @property
    def rt_hourly(self) -> DataFrame:
        return bars.hourly_price_stats(self.rt_15m)

    @property
    def dam_hourly(self) -> DataFrame:
        """Day-ahead price: what was observed in the same hour of the day before."""
        hour = shift_seconds(F.date_trunc("hour", "ts"), 86400)
        return self.events.groupBy(
            hour.alias("utc_ts"), F.concat(F.lit("LZ_"), F.upper("event_type")).alias("location")
        ).agg(rnd(F.avg("k")).alias("price"))

    @property
    def spread(self) -> DataFrame:
        return target.dart_target(self.rt_hourly, self.dam_hourly)

    @property
    def forecast_vintage(self) -> DataFrame:
        delivery = shift_seconds(
            F.date_trunc("hour", "ts"), (F.col("user_id") % 4) * 86400 + (F.col("k") % 24) * 3600
        )
        return self.events.select(
            F.col("ts").alias("posted_datetime"), delivery.alias("utc_ts"), F.col("event_type").alias("location"),
            "value", "event_id",
        )

    @property
    def daily(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(F.col("o_orderdate").cast("timestamp").alias("utc_ts"), F.col("o_orderpriority").alias("location"))
            .agg(rnd(F.avg("o_totalprice"), 4).alias("price"))
        )

    @property
    def predictions(self) -> DataFrame:
        p1 = rnd(F.greatest(F.least(F.col("dam_spp_price") / 100, F.lit(1.0)), F.lit(0.0)))
        s = self.spread.where("dart is not null").withColumn("predicted_prob_class_1", p1)
        s = s.withColumn("predicted_prob_class_0", rnd(1 - F.col("predicted_prob_class_1")))
        return s.select(
            "utc_ts", "local_ts", (F.hour("utc_ts") + 1).alias("end_hour"),
            F.col("location").alias("settlement_point"),
            (F.col("dart") > 0).cast("int").alias("actual_dart_slt"),
            F.col("dart_slt").alias("actual_dart_slt_raw"),
            (F.col("predicted_prob_class_1") > 0.5).cast("int").alias("predicted_dart_slt"),
            "predicted_prob_class_0", "predicted_prob_class_1",
            F.greatest("predicted_prob_class_0", "predicted_prob_class_1").alias("prediction_confidence"),
            F.weekofyear("utc_ts").alias("week_num"),
        )

    @property
    def features_by_hour(self) -> DataFrame:
        """Regression rows: four features and a target, one model hour per row."""
        li = self.table("lineitem").select(
            (F.col("l_orderkey") % 24 + 1).cast("int").alias("end_hour"), F.col("l_shipdate").cast("timestamp").alias("utc_ts"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        )
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        return li.join(part, "l_partkey").withColumn("y", signed_log("l_extendedprice"))
