import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlab.functions.columns import poisson_weight, uniform_hash
from spreadlab.learning import bootstrap, folds, importance, linear, metrics, scoring, selection, targets
from spreadlab.ledger import book, report, signals
from spreadlab.operators import cluster, correlate, describe, encode, lags, vintage
from spreadlab.plans import study
from spreadlab.plans.bindings import Bindings

D = lambda s: dt.datetime.strptime(s, "%Y-%m-%d %H:%M")
LOC = "location string, location_type string, utc_ts timestamp, v double"


def hist(spark, values, rolls):
    t = D("2024-02-01 05:00")
    rows = [("A", "LZ", t - dt.timedelta(days=d), v) for d, v in values.items()] + [("A", "LZ", t, 0.0)]
    out = lags.history_features(spark.createDataFrame(rows, LOC), "v", [24], rolls)
    return out.where(F.col("utc_ts") == F.lit(t)).first()


def test_same_hour_rolling(spark):
    r = hist(spark, {2: 1.0, 4: 3.0}, [3])
    assert (r.v_roll_mean_72hr, r.v_roll_sdev_72hr, r.v_lag_24hr) == (2.0, 1.0, 1.0)
    assert hist(spark, {2: 1.0, 4: None}, [3]).v_roll_mean_72hr is None
    assert hist(spark, {9: 1.0}, [3]).v_roll_mean_72hr is None


def test_calendar_day_features_never_reach_past_the_cutoff(spark, small_dir):
    audit = lags.leakage_audit(Bindings(spark, small_dir).spread)
    assert audit.where("newest_roll_source > cutoff_ts").count() == 0


def test_latest_vintage(spark):
    d = D("2024-01-10 03:00")
    rows = [(d - dt.timedelta(days=2), d, "z", 1.0, 1), (d - dt.timedelta(days=1), d, "z", 2.0, 2), (d - dt.timedelta(days=1), d, "z", 9.0, 3), (d, d, "z", 3.0, 4)]
    df = spark.createDataFrame(rows, "posted_datetime timestamp, utc_ts timestamp, location string, value double, id int")
    assert vintage.latest_vintage(df, "value", tie="id").first().value == 2.0
    assert vintage.vintage_wide(df, "value", ["z", "y"], "f_", tie="id").first().asDict() == {"utc_ts": d, "f_z": 2.0, "f_y": None}


def test_encoders(spark):
    df = spark.createDataFrame([(0, True), (3, False), (None, None)], "day_of_week int, flag boolean")
    hot = encode.one_hot(df).orderBy("flag").collect()
    assert [sum(r[f"day_of_week_{i}"] for i in range(7)) for r in hot] == [0, 1, 1]
    codes = {r.flag: r.flag_le for r in encode.label_encode(df, "flag").collect()}
    assert codes == {False: 0.0, None: 1.0, True: 2.0}


def test_zscore_constant_and_null(spark):
    df = spark.createDataFrame([("A", "LZ", 1.0, 5.0), ("A", "LZ", 3.0, 5.0), ("A", "LZ", None, 5.0)], "location string, location_type string, a double, b double")
    got = sorted([(r.a_z, r.b_z) for r in encode.zscore(df, ["a", "b"]).collect()], key=str)
    assert got == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_feature_lists_differ_by_variant():
    cols = ["dart_slt_lag_24hr", "dart_slt_lag_24hr_z", "load_forecast_coast", "load_forecast_coast_slt", "is_weekend", "is_weekend_le", "day_of_week_0", "etf_hour_sin"]
    assert encode.feature_columns(cols, "exp0") == ["dart_slt_lag_24hr", "is_weekend", "day_of_week_0"]
    assert encode.feature_columns(cols, "exp1") == ["dart_slt_lag_24hr", "load_forecast_coast_slt", "is_weekend_le", "day_of_week_0"]
    assert encode.feature_columns(cols, "exp2") == ["dart_slt_lag_24hr", "load_forecast_coast_slt", "etf_hour_sin"]


def test_study_plan_end_to_end(spark, small_dir):
    b = Bindings(spark, small_dir)
    f = study.Forecast(b.forecast_vintage, "value", "load_forecast_", ["click", "view"], "event_id")
    s = study.build_study(b.rt_hourly, b.dam_hourly, [f])
    assert s.count() == b.rt_hourly.count()
    assert {"etf_days_to_holiday_z", "load_forecast_view_slt_z", "dart_slt_roll_sdev_504hr_z"} <= set(s.columns)
    assert "etf_hour_sin_z" not in s.columns


def test_noise_is_reproducible_and_normal(spark):
    df = spark.range(20000).select("id", encode.standard_normal("id", 3).alias("x"))
    a = df.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(a[0]) < 0.03 and abs(a[1] - 1) < 0.03
    assert df.repartition(7).agg(F.sum(F.round("x", 6).cast("decimal(20,6)"))).first() == df.agg(F.sum(F.round("x", 6).cast("decimal(20,6)"))).first()


def test_poisson_weights(spark):
    r = spark.range(40000).select(uniform_hash("id", 5).alias("u")).select(poisson_weight(F.col("u")).alias("w")).agg(F.avg("w"), F.var_pop("w"), F.avg((F.col("w") == 0).cast("int"))).first()
    assert r[0] == pytest.approx(1, abs=0.03) and r[1] == pytest.approx(1, abs=0.05) and r[2] == pytest.approx(0.3679, abs=0.01)


def test_hashed_numbers_do_not_repeat_with_large_ids(spark):
    ids = [5, 5 + 2147483647, 5 + 2**40, -5]
    for stream in (0, 9):
        got = [r.u for r in spark.createDataFrame([(i,) for i in ids], "id long").select(uniform_hash("id", stream).alias("u")).collect()]
        assert len(set(got)) == len(ids) and all(0 <= u < 1 for u in got)
    top = spark.createDataFrame([(1 - 2.0**-52,), (0.0,)], "u double").select(poisson_weight(F.col("u")).alias("w")).collect()
    assert top[0].w >= 16 and top[1].w == 0


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(5)
    rows = []
    for h in (1, 2):
        x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [5, -3, 1]
        y = x @ [2, 0.5 * h, 0] + 7 + rng.normal(size=300) * 0.3
        rows += [(h, *map(float, a), float(t)) for a, t in zip(x, y)]
    return spark.createDataFrame(rows, "end_hour int, a double, b double, c double, y double").cache()


def as_matrix(df, h):
    m = df.where(F.col("end_hour") == h).toPandas()
    return m[["a", "b", "c"]].to_numpy(), m["y"].to_numpy()


def coef(df, h, alpha=None):
    q = df.where(F.col("end_hour") == h)
    return {r.feature: r.coefficient for r in (q if alpha is None else q.where(F.col("alpha") == alpha)).collect()}


def test_linear_models_match_direct_solutions(regression):
    for h in (1, 2):
        x, y = as_matrix(regression, h)
        xc, yc = x - x.mean(0), y - y.mean()
        ols = coef(linear.fit_linear(regression, ["end_hour"], ["a", "b", "c"], "y"), h)
        w = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
        assert [ols["a"], ols["b"], ols["c"], ols[linear.INTERCEPT]] == pytest.approx(list(w), abs=1e-8)
        ridge = coef(linear.fit_linear(regression, ["end_hour"], ["a", "b", "c"], "y", "ridge", [5.0]), h)
        assert [ridge[k] for k in "abc"] == pytest.approx(list(np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc)), abs=1e-9)
        las = coef(linear.fit_linear(regression, ["end_hour"], ["a", "b", "c"], "y", "lasso", [0.05, 0.5]), h, 0.5)
        v = np.array([las[k] for k in "abc"])
        grad = xc.T @ (yc - xc @ v) / len(y)
        for g, k in zip(grad, v):
            assert (abs(g) <= 0.5 + 1e-7) if k == 0 else g == pytest.approx(0.5 * np.sign(k), abs=1e-7)


def test_wide_and_narrow_moments_agree(regression):
    key = lambda d: sorted((r.end_hour, r.a, r.b, r.n, round(r["cov"], 9), round(r.mean_a, 9)) for r in d.collect())
    args = (["end_hour"], ["a", "b", "c", "y"])
    narrow, wide = key(correlate.co_moments(regression, *args)), key(correlate.co_moments(regression, *args, jvm_columns=1))
    assert narrow == wide


def test_correlations_match_numpy(regression):
    x, y = as_matrix(regression, 1)
    m = np.corrcoef(np.c_[x, y].T)
    got = {(r.a, r.b): r.r for r in correlate.correlation_matrix(regression, ["end_hour"], ["a", "b", "c", "y"]).where("end_hour = 1").collect()}
    assert len(got) == 16 and got[("c", "y")] == pytest.approx(m[2, 3]) and got[("y", "c")] == got[("c", "y")]


def test_thin_groups_fall_back_to_a_random_fifth(spark):
    df = spark.createDataFrame([(1, i, float(i), 2.0 * i) for i in range(6)], "end_hour int, id long, a double, y double")
    out = linear.bootstrap_oob(df, ["end_hour"], ["a"], "y", F.col("id"), n=4)
    assert all(r["count"] >= 5 for r in out.groupBy("replicate").count().collect())


def test_walk_forward_equals_refitting_each_week(spark):
    rng = np.random.default_rng(2)
    t = [D("2025-01-01 00:00") + dt.timedelta(hours=3 * i) for i in range(300)]
    rows = [(1 + i % 2, ts, float(rng.normal()), 0.0) for i, ts in enumerate(t)]
    rows = [(h, ts, x, 3 * x + h + float(rng.normal())) for h, ts, x, _ in rows]
    df = spark.createDataFrame(rows, "end_hour int, utc_ts timestamp, x double, y double")
    weeks = folds.operational_weeks(df, "2025-01-01")
    got = {(r.end_hour, r.utc_ts): r.prediction for r in linear.walk_forward_linear(df, ["end_hour"], ["x"], "y", weeks, "2025-01-01").collect()}
    pdf, n = df.toPandas(), 0
    for w in weeks.collect():
        s = dt.datetime.combine(w.val_start_date, dt.time())
        for h in (1, 2):
            tr, va = (pdf[(pdf.end_hour == h) & c] for c in (pdf.utc_ts < s, (pdf.utc_ts >= s) & (pdf.utc_ts < s + dt.timedelta(days=7))))
            b, a = np.polyfit(tr.x, tr.y, 1)
            for r in va.itertuples():
                assert got[(h, r.utc_ts.to_pydatetime())] == pytest.approx(a + b * r.x, abs=1e-8)
                n += 1
    assert n == len(got) > 100


def test_operational_weeks_of_2025(spark):
    df = spark.createDataFrame([(D("2025-06-04 10:00"),)], "utc_ts timestamp")
    w = folds.operational_weeks(df).orderBy("week_num").collect()
    assert len(w) == 21 and str(w[0].val_start_date) == "2025-01-05" and str(w[-1].val_end_date) == "2025-05-31"
    assert w[0].week_description == "Jan 05 - Jan 11, 2025" and str(w[0].train_end_date) == "2025-01-04"
    assert folds.operational_weeks(df, max_weeks=3).count() == 3


def test_saturday_belongs_to_training_unless_cut_at_midnight(spark):
    df = spark.createDataFrame([(D("2025-01-11 12:00"),), (D("2025-01-11 00:00"),), (D("2025-01-12 00:00"),)], "utc_ts timestamp")
    f = {r.utc_ts: (r.val_week, r.first_train_week) for r in folds.assign_folds(df).collect()}
    assert f[D("2025-01-11 12:00")] == (1, 2) and f[D("2025-01-12 00:00")] == (2, 3)
    g = {r.utc_ts: r.first_train_week for r in folds.assign_folds(df, midnight_cut=True).collect()}
    assert g[D("2025-01-11 12:00")] == 3 and g[D("2025-01-11 00:00")] == 2


def test_class_targets(spark):
    df = spark.createDataFrame([(float(x),) for x in (-13, -12, -5, 0, 5, 12, 13)], "x double")
    got = df.select(targets.manual_class("x", [-12, -5, 5, 12]).alias("m"), targets.sign_class("x").alias("s")).collect()
    assert [r.m for r in got] == [0, 0, 1, 2, 2, 3, 4] and [r.s for r in got] == [0, 0, 0, 0, 1, 1, 1]


def test_elbow(spark):
    df = spark.createDataFrame([("A", "LZ", k, float(v)) for k, v in enumerate((100, 40, 20, 15, 12), 1)], "location string, location_type string, k int, inertia double")
    r = cluster.elbow_point(df).first()
    assert (r.elbow_k, r.distance) == (2, pytest.approx(0.3053, abs=1e-4))
    assert cluster.elbow_point(df.where("k <= 2")).first().elbow_k == 2
    for bad in ("nan", "inf"):
        broken = df.withColumn("inertia", F.when(F.col("k") == 4, F.lit(float(bad))).otherwise(F.col("inertia")))
        r = cluster.elbow_point(broken).first()
        assert (r.elbow_k, r.distance) == (2, None)
    late = df.withColumn("inertia", F.when(F.col("k") <= 2, F.lit(float("nan"))).otherwise(F.col("inertia")))
    assert cluster.elbow_point(late).first().elbow_k == 3


def test_kmeans_values_find_separated_groups_and_exact_silhouette(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(m, 0.3, 60) for m in (-10, 0, 10)] + [np.full(40, 10.0)]), 3)
    df = spark.createDataFrame([("A", "LZ", float(v)) for v in x], "location string, location_type string, v double")
    points, centres = cluster.kmeans_values(df, "v", max_k=3)
    t = cluster.cluster_table(points, centres).where("k = 3").orderBy("centre").collect()
    assert [round(r.centre) for r in t] == [-10, 0, 10] and [r["size"] for r in t] == [60, 60, 100]
    one = cluster.inertia_table(cluster.cluster_table(points, centres)).where("k = 1").first().inertia
    assert one == pytest.approx(((x - x.mean()) ** 2).sum())
    for row in cluster.silhouette(points, centres).collect():
        c = np.array(centres.where(F.col("k") == row.k).first().centres)
        lab = np.abs(x[:, None] - c).argmin(1)
        dist = np.abs(x[:, None] - x[None])
        s = []
        for i in range(len(x)):
            own = (lab == lab[i]).sum()
            a = dist[i][lab == lab[i]].sum() / max(own - 1, 1)
            b = min(dist[i][lab == j].mean() for j in set(lab) if j != lab[i])
            s.append(0 if own == 1 else (b - a) / max(a, b))
        assert row.silhouette == pytest.approx(np.mean(s), abs=1e-9)


PRED = "strategy string, settlement_point string, utc_ts timestamp, end_hour int, actual_dart_slt int, predicted_dart_slt int, week_num int, predicted_prob_class_0 double, predicted_prob_class_1 double, prediction_confidence double, actual_dart_slt_raw double, direction string"


def pred_rows(outcomes, directions=None, point="P"):
    t = D("2024-01-01 00:00")
    return [("s", point, t + dt.timedelta(hours=i * 31), 1 + i % 24, a, 1, 1, 0.4, 0.6, 0.6, 0.1, (directions or ["long"] * len(outcomes))[i]) for i, a in enumerate(outcomes)]


def test_gated_ledger_example(spark):
    df = spark.createDataFrame(pred_rows([0, 0, 1]), PRED)
    led = book.capital_ledger(book.bet_pnl(df, 0.05), 3.0, 0.05).orderBy("utc_ts").collect()
    assert [float(r.capital_after) for r in led] == [1.9, 0.8, 0.8] and [r.placed for r in led] == [True, True, False]


def test_ledger_equals_sequential_fold(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for p in range(12):
        out = [rng.randint(0, 1) for _ in range(150)]
        dirs = [rng.choice(["long", "short", "no_trade"]) for _ in out]
        rows += pred_rows(out, dirs, f"P{p}")
        cap, trace = 8000000, []
        for a, d in zip(out, dirs):
            if d != "no_trade" and cap >= 1100000:
                cap += 900000 if (d == "long") == (a == 1) else -1100000
            trace.append(cap)
        expected[f"P{p}"] = trace
    led = book.capital_ledger(book.bet_pnl(spark.createDataFrame(rows, PRED), 0.05), 8.0, 0.05).orderBy("settlement_point", "utc_ts").collect()
    got = {}
    for r in led:
        got.setdefault(r.settlement_point, []).append(int(r.capital_after * 1000000))
    assert got == expected and any(t[-1] < 1100000 for t in expected.values())


def test_always_long_books_shorts_as_longs(spark):
    df = spark.createDataFrame(pred_rows([0, 1], ["short", "short"]), PRED)
    assert [float(r.pnl) for r in book.bet_pnl(df, always_long=True).orderBy("utc_ts").collect()] == [-1.1, 0.9]
    assert [float(r.pnl) for r in book.bet_pnl(df).orderBy("utc_ts").collect()] == [0.9, -1.1]


def test_sharpe_and_drawdown(spark):
    t = D("2024-01-01 00:00")
    df = spark.createDataFrame([("s", "P", t + dt.timedelta(days=60 * i), 1, float(v)) for i, v in enumerate((100, 101, 99, 99, 102))],
                               "strategy string, settlement_point string, utc_ts timestamp, end_hour int, portfolio_value double")
    assert book.sharpe_ratio(df).first().sharpe_ratio == pytest.approx(22.996964, abs=1e-5)
    assert book.max_drawdown(df).first().max_drawdown_pct == pytest.approx(-1.980198, abs=1e-6)


def test_weekly_accuracy_weeks_end_on_sunday(spark):
    rows = [("2024-01-02 10:00", True), ("2024-01-03 00:00", False), ("2024-01-07 12:00", True), ("2024-01-08 00:00", True), ("2024-01-22 05:00", True)]
    df = spark.createDataFrame([("s", "P", 1, D(t), ok) for t, ok in rows], "strategy string, settlement_point string, entry_hour int, entry_time timestamp, correct_prediction boolean")
    got = [(str(r.week_end), r.trade_count, r.accuracy_pct) for r in report.weekly_accuracy_by_hour(df).orderBy("week_end").collect()]
    assert got == [("2024-01-07", 3, pytest.approx(66.6667, abs=1e-3)), ("2024-01-14", 1, 100.0), ("2024-01-21", 0, None), ("2024-01-28", 1, 100.0)]


def test_thresholds_fall_back_to_the_median(spark):
    df = spark.createDataFrame([("P", 1, 0.5), ("P", 1, 0.9), ("P", 2, 0.7)], "settlement_point string, end_hour int, prediction_confidence double")
    t = {r.end_hour: (r.threshold, r.total_predictions) for r in signals.hour_thresholds(df, percentile=0.5).collect()}
    assert len(t) == 24 and t[1] == (0.7, 2) and t[3] == (0.7, 0)


def test_confidence_needs_some_column():
    with pytest.raises(ValueError):
        signals.confidence(["utc_ts"])


def test_duplicate_dataset_key_fails_the_join(spark):
    p = spark.createDataFrame([(1, 0.5)], "k int, p double")
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        scoring.join_predictions(p, d, ["k"]).collect()


def test_hour_similarity(spark):
    df = spark.createDataFrame([(h, f) for h, fs in ((1, "abc"), (2, "bcd")) for f in fs], "end_hour int, feature string")
    assert importance.hour_similarity(df).first().similarity == 0.5


def test_one_hour_has_no_stability(spark):
    top = spark.createDataFrame([(7, "a", 0), (7, "b", 1)], "end_hour int, feature string, rank int")
    assert {r.stability for r in importance.feature_stability(top).collect()} == {0.0}


def test_history_features_can_be_left_out():
    cols = ["dart_slt_lag_24hr", "dart_slt_roll_mean_24hr", "load_forecast_a_slt", "etf_dow_sin"]
    assert encode.feature_columns(cols, history=False) == ["load_forecast_a_slt", "etf_dow_sin"]


def test_spikes_are_null_without_any(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", 1.0, 1.0)], "k string, y double, p double")
    r = metrics.spike_metrics(df, ["k"], "y", "p").first()
    assert r.spike_f1_score is None and r.spike_count_true == 0


def test_tuning_helpers(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0.6, 3), (1, 1, 0.65, 0.6, 5), (2, 2, 0.7, 0.7, 8)], "end_hour int, trial int, train_accuracy double, validation_accuracy double, depth int")
    best = selection.best_trials(selection.tuning_score(df, 0.2), ["end_hour"], "trial")
    assert {r.end_hour: r.trial for r in best.collect()} == {1: 1, 2: 2}
    assert selection.median_parameters(best, ["depth"]).first().depth == 6.5


def test_measured_join_gives_the_same_rows_on_both_paths(spark):
    from spreadlab.session import join_measured

    a = spark.createDataFrame([(i % 5, float(i)) for i in range(50)], "k int, v double")
    m = a.groupBy("k").agg(F.avg("v").alias("m"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(join_measured(a, m, ["k"])) == rows(join_measured(a, m, ["k"], max_bytes=2)) == rows(a.join(m, "k"))


def test_null_series_keys_are_kept(spark):
    from pyspark.sql import Window

    from spreadlab.operators import blocks

    t = D("2024-01-01 00:00")
    df = spark.createDataFrame([(None if i % 2 else "a", t + dt.timedelta(days=i), float(i)) for i in range(40)], "k string, ts timestamp, v double")
    got = blocks.running(df, ["k"], "ts", blocks.time_block("ts", 3), s=("sum", "v"))
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda d: sorted((str(r.k), r.ts, r.s) for r in d.collect())
    assert key(got) == key(df.withColumn("s", F.sum("v").over(w)))


def test_lasso_path_leaves_no_duality_gap():
    rng = np.random.default_rng(0)
    for turn in range(60):
        d = int(rng.integers(1, 8))
        x = rng.normal(size=(50, d))
        if d > 2 and turn % 3 == 0:
            x[:, 1] = x[:, 0] + rng.normal(size=50) * 0.01
        if turn % 7 == 0:
            x[:, -1] = 0
        y = x @ rng.normal(size=d) + rng.normal(size=50)
        x, y = x - x.mean(axis=0), y - y.mean()
        cov, cxy, vy = x.T @ x / 50, x.T @ y / 50, float(y @ y / 50)
        for alpha in (1e-4, 0.01, 0.1, 0.5, 2.0):
            assert abs(linear.duality_gap(cov, cxy, vy, linear.lasso_at(cov, cxy, alpha), alpha)) < 1e-9
    assert linear.duality_gap(cov, cxy, vy, linear.lasso_at(cov, cxy, 0.01) + 0.1, 0.01) > 1e-4


def test_replicates_draw_as_many_rows_as_the_group_has(spark):
    rows = [(k % 3, k * 70_000, float(k)) for k in range(600)] + [(7, 1, 1.0), (7, 1, 2.0)]
    df = spark.createDataFrame(rows, "end_hour int, id long, v double").repartition(4)
    weighed = linear.resampled(df, ["end_hour"], F.col("id"), 6, ties=["v"])
    assert weighed.columns == ["end_hour", "id", "v", "weights"] and weighed.count() == len(rows)
    sums = linear.by_replicate(weighed).groupBy("end_hour", "replicate").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.max("weight").alias("m")).collect()
    assert len(sums) == 4 * 6 and all(r.w == r.n for r in sums)
    assert max(r.m for r in sums if r.n > 2) >= 3
    again = linear.resampled(df.repartition(2), ["end_hour"], F.col("id"), 6, ties=["v"])
    assert sorted(map(str, again.collect())) == sorted(map(str, weighed.collect()))
    # A third or so of the rows of a group are left out, and replicates differ.
    left = linear.by_replicate(weighed).where("end_hour < 3").groupBy("replicate").agg(F.avg((~F.col("drawn")).cast("int")).alias("o")).collect()
    assert all(0.25 < r.o < 0.5 for r in left) and len({r.o for r in left}) > 2


def test_vector_clusters_by_plain_loops(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in (0.0, 3.0, 6.0)]), 2)
    x = np.concatenate([x, x[:10]])
    rows = [("a", float(a), float(b)) for a, b in x] + [("b", float(a), float(-b)) for a, b in x[::3]] + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "kind string, p double, q double").repartition(3)
    got = {(r.kind, r.k): r for r in cluster.kmeans_vectors(df, ["p", "q"], [1, 2, 3, 4], ["kind"]).collect()}
    for kind, own in (("a", x), ("b", x[::3] * [1, -1])):
        n = len(own)
        for k in (1, 2, 3, 4):
            at = [int(np.floor((n - 1) * (i + 0.5) / k)) for i in range(k)]
            c = np.sort(own, axis=0)[at]
            while True:
                near = ((own[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                new = np.array([own[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
                if np.abs(new - c).max() <= 1e-9:
                    break
                c = new
            r = got[kind, k]
            assert r.n_rows == n and r.inertia == pytest.approx(((own - c[near]) ** 2).sum()) and r.sizes == sorted(np.bincount(near, minlength=k).tolist(), reverse=True)
            if k > 1:
                apart = ((own[:, None] - own[None]) ** 2).sum(axis=2)
                sil = []
                for i in range(n):
                    mean = [apart[i][near == j].sum() / max((near == j).sum() - (j == near[i]), 1) if (near == j).any() else np.inf for j in range(k)]
                    a, b = mean[near[i]], min(v for j, v in enumerate(mean) if j != near[i])
                    sil.append((b - a) / max(a, b) if (near == near[i]).sum() > 1 and b < np.inf else 0.0)
                assert r.silhouette == pytest.approx(np.mean(sil), abs=1e-9)
            else:
                assert r.silhouette is None
    assert cluster.kmeans_vectors(df.limit(0), ["p", "q"], [1, 2], ["kind"]).count() == 0


def test_vector_clusters_settle_on_the_vectors_that_can_change(spark, monkeypatch):
    """Fewer passes over all vectors than rounds, with the centres of the rounds."""
    monkeypatch.setattr(cluster, "FEW", 1200)
    x = np.random.default_rng(5).random((3000, 2))
    c, rounds = np.sort(x, axis=0)[[int(np.floor(2999 * (i + 0.5) / 6)) for i in range(6)]], 0
    while True:
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == i].mean(axis=0) for i in range(6)])
        rounds += 1
        if np.abs(new - c).max() <= 1e-9:
            break
        c = new
    df = spark.createDataFrame(x.tolist(), "p double, q double").repartition(3)
    (r,) = cluster.kmeans_vectors(df, ["p", "q"], [6], turns=rounds - 2).collect()
    assert r.inertia == pytest.approx(((x - c[near]) ** 2).sum()) and r.sizes == sorted(np.bincount(near).tolist(), reverse=True)


def test_resampling_tasks_grow_in_number_with_the_draws(spark, monkeypatch):
    monkeypatch.setattr(linear, "TASK_DRAWS", 100, raising=False)
    df = spark.range(1000).select(F.lit(1).alias("end_hour"), "id")
    weighed = linear.resampled(df, ["end_hour"], F.col("id"), 4)
    assert weighed.count() == 1000 and weighed.select(F.input_file_name()).distinct().count() >= 32
    assert weighed.select(*[F.sum(F.get("weights", i)) for i in range(4)]).first() == (1000,) * 4


def test_two_nearest_centres_are_those_of_all_distances():
    import numpy as np

    from spreadlab.operators.cluster import _two_nearest

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (500, 4)).astype(float)
    for centres in (x[:1], x[[0, 1, 0, 2]], rng.normal(size=(6, 4))):
        every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        near, first, second = _two_nearest(np.ascontiguousarray(x.T), centres)
        assert near.tolist() == every.argmin(axis=1).tolist() and first.tolist() == every.min(axis=1).tolist()
        assert second.tolist() == (np.sort(every, axis=1)[:, 1].tolist() if len(centres) > 1 else [np.inf] * 500)
