"""Time-window moments, rolling autocorrelation, sign transitions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import corrected_kurtosis, corrected_skew
from spreadlab.operators.blocks import BLK, DAY, own_rows, previous, row_numbers, running, time_block, with_halo
from spreadlab.operators.describe import fill_slots
from spreadlab.session import join_measured

POINT = ["location", "location_type"]


def moving_window_stats(df: DataFrame, value: str = "dart_slt", hours: int = 168, min_rows: int = 24, keys: list[str] = POINT,
                        ts: str = "utc_ts", block_days: int = 120) -> DataFrame:
    """Mean, deviation, skew, excess kurtosis and positive share over (t - W, t]; short windows drop out.

    Power sums of values centred on the series mean give all moments from one window.
    """
    src = df.where(F.col(value).isNotNull()).select(*keys, ts, value)
    centre = src.groupBy(*keys).agg(F.avg(value).alias("__c"))
    src = join_measured(src, centre, keys).withColumn("__x", F.col(value) - F.col("__c")).withColumn("__us", F.unix_micros(ts))
    back = hours * 3600 * 1000000
    width = max(block_days * DAY * 1000000, 2 * back)
    h = with_halo(src, F.col("__us"), width, back)
    w = Window.partitionBy(*keys, BLK).orderBy("__us").rangeBetween(-back + 1, 0)
    x = F.col("__x")
    h = h.select(
        *keys, ts, "__own", BLK, "__c", F.count(x).over(w).cast("double").alias("n"), F.sum(x).over(w).alias("s1"),
        F.sum(x * x).over(w).alias("s2"), F.sum(x * x * x).over(w).alias("s3"), F.sum(x * x * x * x).over(w).alias("s4"),
        F.sum((F.col(value) > 0).cast("int")).over(w).alias("npos"))
    d = own_rows(h).where(F.col("n") >= min_rows)
    n, m = F.col("n"), F.col("s1") / F.col("n")
    m2 = F.col("s2") - n * m * m
    m3 = F.col("s3") - 3 * m * F.col("s2") + 2 * n * m * m * m
    m4 = F.col("s4") - 4 * m * F.col("s3") + 6 * m * m * F.col("s2") - 3 * n * F.pow(m, 4)
    return d.select(
        *keys, ts, n.cast("long").alias("n"), (F.col("__c") + m).alias("rolling_mean"), F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)).alias("rolling_std"),
        corrected_skew(n, m2, m3).alias("rolling_skew"), corrected_kurtosis(n, m2, m4).alias("rolling_kurtosis"),
        (100.0 * F.col("npos") / n).alias("positive_pct"))


def rolling_autocorr(df: DataFrame, value: str = "dart_slt", lag: int = 24, hours: int = 168, min_rows: int = 48,
                     keys: list[str] = POINT, ts: str = "utc_ts", block_days: int = 120) -> DataFrame:
    """Pearson correlation of x_i with x_{i-lag}, both inside (t - W, t]; pairs are positional.

    A pair counts when its earlier row also lies in the window, so each window sum is a
    running sum minus the running sum at the window's first complete pair.
    """
    src = df.where(F.col(value).isNotNull()).select(*keys, ts, value)
    centre = src.groupBy(*keys).agg(F.avg(value).alias("__c"))
    src = row_numbers(join_measured(src, centre, keys).withColumn("__x", F.col(value) - F.col("__c")), keys, ts, time_block(ts), "__rn")
    src = src.withColumn("__us", F.unix_micros(ts))
    back = hours * 3600 * 1000000
    h = with_halo(src, F.col("__us"), max(block_days * DAY * 1000000, 2 * back), back)
    order = Window.partitionBy(*keys, BLK).orderBy("__us")
    frame = order.rangeBetween(-back + 1, 0)
    cum = order.rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("__y", F.lag("__x", lag).over(order))
    parts = {"n": F.lit(1.0), "x": F.col("__x"), "y": F.col("__y"), "xx": F.col("__x") * F.col("__x"),
             "yy": F.col("__y") * F.col("__y"), "xy": F.col("__x") * F.col("__y")}
    have = F.col("__y").isNotNull()
    h = h.select("*", F.min("__rn").over(frame).alias("__first"), F.count("*").over(frame).alias("__rows"),
                 *[F.sum(F.when(have, e).otherwise(0.0)).over(cum).alias(f"__p_{k}") for k, e in parts.items()])
    # The running sums at row number first + lag - 1 are looked up inside the block.
    packed = F.struct(F.col("__rn").alias("rn"), *[F.col(f"__p_{k}").alias(k) for k in parts])
    look = h.select(*keys, BLK, packed.alias("__before"))
    lk = look.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(BLK).alias("__kb"), "__before", F.col("__before.rn").alias("__krn"))
    cand = h.where((F.col("__own")) & (F.col("__rows") >= min_rows))
    on = [cand[BLK] == lk["__kb"], cand["__first"] + (lag - 1) == lk["__krn"]] + [cand[k].eqNullSafe(lk[f"__k_{k}"]) for k in keys]
    j = cand.join(lk, on, "left")
    s = {k: F.col(f"__p_{k}") - F.coalesce(F.col(f"__before.{k}"), F.lit(0.0)) for k in parts}
    n = s["n"]
    cov = s["xy"] - s["x"] * s["y"] / n
    vx, vy = s["xx"] - s["x"] * s["x"] / n, s["yy"] - s["y"] * s["y"] / n
    r = F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))
    return j.select(*keys, ts, F.col("__rows").alias("n"), n.cast("long").alias("n_pairs"), F.when(n >= 2, r).alias("autocorr"))


def _signs(df: DataFrame, value: str, keys: list[str], ts: str, extra: list[str] = []) -> DataFrame:
    src = df.where(F.col(value).isNotNull()).select(
        *keys, ts, *extra, F.when(F.col(value) > 0, "Positive").otherwise("Negative").alias("state"))
    return previous(src, keys, ts, time_block(ts), {"from_state": "state"})


def sign_transitions(df: DataFrame, value: str = "dart_slt", keys: list[str] = POINT, ts: str = "utc_ts") -> DataFrame:
    """Counts of (from, to) sign pairs and their share of the from-state; zero counts as negative."""
    pairs = _signs(df, value, keys, ts).where("from_state is not null").groupBy(*keys, "from_state", F.col("state").alias("to_state")).agg(
        F.count("*").alias("n"))
    row = F.sum("n").over(Window.partitionBy(*keys, "from_state"))  # at most two rows per partition
    return pairs.withColumn("probability", F.col("n") / row)


def sign_runs(df: DataFrame, value: str = "dart_slt", keys: list[str] = POINT, ts: str = "utc_ts") -> DataFrame:
    """One row per run of equal signs with its length."""
    s = _signs(df, value, keys, ts).withColumn("__new", F.coalesce(F.col("state") != F.col("from_state"), F.lit(True)).cast("int"))
    islands = running(s, keys, ts, time_block(ts), __island=("sum", "__new"))
    return islands.groupBy(*keys, "__island", "state").agg(F.count("*").alias("run_length")).drop("__island")


def run_length_stats(runs: DataFrame, keys: list[str] = POINT) -> DataFrame:
    return runs.groupBy(*keys, "state").agg(
        F.count("*").alias("n_runs"), F.avg("run_length").alias("mean_run_length"), F.max("run_length").alias("max_run_length"))


def run_length_histogram(runs: DataFrame, keys: list[str] = POINT) -> DataFrame:
    return runs.groupBy(*keys, "state", "run_length").agg(F.count("*").alias("n_runs"))


def sign_changes_by(df: DataFrame, slot: str, slots: list[int], value: str = "dart_slt", keys: list[str] = POINT, ts: str = "utc_ts") -> DataFrame:
    """Real sign changes per hour or weekday, absent slots as zero."""
    s = _signs(df, value, keys, ts, [slot]).where("from_state is not null")
    counts = s.groupBy(*keys, slot).agg(F.count_if(F.col("state") != F.col("from_state")).alias("n_changes"))
    return fill_slots(counts, keys, slot, slots, ["n_changes"])
