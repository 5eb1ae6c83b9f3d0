"""Blocked scans, halos and percentiles against plain computations, hot series included."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadlab.operators import blocks, lags, moving, quantiles, spectrum

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """One series with two thirds of the rows, gaps and nulls; two small ones."""
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 400), ("b", 120), ("c", 1)):
        t = 0
        for i in range(n):
            t += rng.choice([1, 1, 1, 2, 40])
            v = None if rng.random() < 0.05 else round(rng.gauss(0, 5), 3)
            rows.append((key, "LZ", i, T0 + dt.timedelta(hours=t), v))
    return spark.createDataFrame(rows, "location string, location_type string, i long, utc_ts timestamp, v double").cache()


def text(v):
    return f"{v:.7f}" if isinstance(v, float) else str(v)


def same(a, b, cols):
    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df.select(*cols).collect())
    assert rows(a) == rows(b)


KEYS = ["location", "location_type"]


@pytest.mark.parametrize("days", [1, 7, 10000])
def test_running_previous_and_row_numbers(series, days):
    w = Window.partitionBy(*KEYS).orderBy("utc_ts")
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    blk = blocks.time_block("utc_ts", days)
    got = blocks.running(series, KEYS, "utc_ts", blk, s=("sum", "v"), hi=("max", "v"), lo=("min", "v"), n=("count", "v"))
    exp = series.select("*", F.sum("v").over(f).alias("s"), F.max("v").over(f).alias("hi"), F.min("v").over(f).alias("lo"), F.count("v").over(f).alias("n"))
    same(got, exp, ["location", "i", "s", "hi", "lo", "n"])
    same(blocks.row_numbers(series, KEYS, "utc_ts", blk), series.withColumn("rn", F.row_number().over(w)), ["location", "i", "rn"])
    same(blocks.previous(series, KEYS, "utc_ts", blk, {"p": "v", "pt": "utc_ts"}),
         series.withColumn("p", F.lag("v").over(w)).withColumn("pt", F.lag("utc_ts").over(w)), ["location", "i", "p", "pt"])


@pytest.mark.parametrize("days", [2, 10000])
def test_prefix_sum_and_low(series, days):
    d = series.withColumn("x", F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy(*KEYS).orderBy("utc_ts").rowsBetween(Window.unboundedPreceding, 0)
    exp = d.withColumn("b", F.sum("x").over(w) - F.col("x")).withColumn("m", F.min("b").over(w))
    same(blocks.prefix_sum_and_low(d, KEYS, "utc_ts", blocks.time_block("utc_ts", days), "x", "b", "m"), exp, ["location", "i", "b", "m"])


def test_halo_lags_cross_block_edges(series, monkeypatch):
    monkeypatch.setattr(lags, "ROWS_PER_BLOCK", 1)
    w = Window.partitionBy(*KEYS).orderBy("utc_ts")
    got = lags.lag_rows(series, "v", [2, 5])
    exp = series.select("*", F.lag("v", 2).over(w).alias("v_lag_2hr"), F.lag("v", 5).over(w).alias("v_lag_5hr"))
    same(got, exp, ["location", "i", "v_lag_2hr", "v_lag_5hr"])
    got = lags.rolling_rows_shifted(series, "v", [4, 9], shift=3)
    f = w.rowsBetween(-11, -3)
    same(got, series.withColumn("v_roll_sdev_9hr", F.stddev_samp("v").over(f)), ["location", "i", "v_roll_sdev_9hr"])


def test_history_features_do_not_depend_on_block_width(series):
    narrow = lags.history_features(series, "v", [2, 24], [3, 7], block_days=1)
    wide = lags.history_features(series, "v", [2, 24], [3, 7], block_days=100000)
    same(narrow, wide, narrow.columns)


def test_moving_stats_and_autocorr_do_not_depend_on_block_width(series):
    a, b = (moving.moving_window_stats(series, "v", 48, 5, block_days=d) for d in (1, 100000))
    same(a, b, a.columns)
    a, b = (moving.rolling_autocorr(series, "v", 3, 48, 8, block_days=d) for d in (1, 100000))
    same(a, b, a.columns)


def test_rolling_autocorr_brute_force(series):
    got = {(r.location, r.utc_ts): r.autocorr for r in moving.rolling_autocorr(series, "v", 3, 48, 8, block_days=2).collect()}
    pdf = series.where("v is not null").toPandas().sort_values("utc_ts")
    for key, g in pdf.groupby("location"):
        ts, v = g["utc_ts"].to_numpy(), g["v"].to_numpy()
        for i in range(len(g)):
            x = v[(ts > ts[i] - np.timedelta64(48, "h")) & (ts <= ts[i])]
            r = got.get((key, g["utc_ts"].iloc[i].to_pydatetime()))
            if len(x) < 8:
                assert r is None
            else:
                assert r == pytest.approx(np.corrcoef(x[3:], x[:-3])[0, 1], abs=1e-9)


def test_exact_quantiles_match_numpy_with_ties_and_one_hot_key(spark):
    rng = np.random.default_rng(1)
    data = {"hot": np.concatenate([np.zeros(3000), np.round(rng.normal(0, 3, 4000), 2)]), "small": np.array([1.0, 2, 2, 3, 9, 4]), "one": np.array([-7.5])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("small", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    for r in quantiles.exact_quantiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(data[r.k], p * 100), abs=1e-12)
    assert quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(np.concatenate(list(data.values()))))


def test_order_positions_expand_ties_in_chunks(spark):
    df = spark.createDataFrame([("k", 1.0)] * 25 + [("k", 0.5)] * 3 + [("k", 2.0)], "k string, v double")
    got = sorted((r.position, r.value) for r in quantiles.order_positions(df, ["k"], "v", chunk=4).collect())
    assert got == [(i + 1, v) for i, v in enumerate([0.5] * 3 + [1.0] * 25 + [2.0])]


@pytest.mark.parametrize(("n", "cells"), [(2, 1), (3, 2), (7, 1 << 16), (64, 3), (97, 40), (240, 1)])
def test_split_transform_equals_fft(spark, n, cells):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    df = spark.createDataFrame([("s", int(i), float(v), n) for i, v in enumerate(x)], "k string, idx long, value double, n long")
    got = spectrum.distributed_dft(df, ["k"], cells).orderBy("bin").toPandas()
    exp = np.fft.fft(x)[: n // 2]
    assert list(got["bin"]) == list(range(n // 2))
    assert np.allclose(got["re"] + 1j * got["im"], exp, atol=1e-8)


def test_power_spectrum_equals_fft_of_each_series(series):
    got = spectrum.power_spectrum(series, "v").orderBy("location", "bin").toPandas()
    rows = series.orderBy("utc_ts").toPandas().dropna(subset=["v"])
    for location, part in got.groupby("location"):
        x = rows[rows["location"] == location]["v"].to_numpy()
        f = np.abs(np.fft.fft(x)[: len(x) // 2]) ** 2 / len(x)
        f[1:] *= 2
        assert np.allclose(part["power"], f, rtol=1e-7, atol=1e-9)


def test_positions_of_one_frequent_value_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from spreadlab.operators.quantiles import order_positions

    df = spark.range(1000).select(F.lit("s").alias("k"), F.when(F.col("id") < 900, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    out = order_positions(df, ["k"], "v", chunk=50)
    assert out.agg(F.countDistinct("position"), F.min("position"), F.max("position")).first() == (1000, 1, 1000)
    assert "repartition" in out._jdf.queryExecution().logical().toString().lower()
