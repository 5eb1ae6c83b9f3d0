import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spreadlab.functions import columns as c
from spreadlab.functions import timeconv as tc
from spreadlab.operators import calendar, clean
from spreadlab.plans import etl
from spreadlab.sources import contracts, payload, tables

D = lambda s: dt.datetime.strptime(s, "%Y-%m-%d %H:%M")

TRUTH = [
    ("2024-01-01", 23, False, "2024-01-02 05:00"), ("2024-07-01", 0, False, "2024-07-01 05:00"), ("2024-03-10", 1, False, "2024-03-10 07:00"),
    ("2024-03-10", 2, False, "2024-03-10 08:00"), ("2024-03-10", 3, False, "2024-03-10 08:00"), ("2024-11-03", 0, False, "2024-11-03 05:00"),
    ("2024-11-03", 1, False, "2024-11-03 06:00"), ("2024-11-03", 1, True, "2024-11-03 07:00"), ("2024-11-03", 2, False, "2024-11-03 08:00"),
    ("2024-06-01", 1, True, "2024-06-01 06:00"),
]


def test_local_to_utc_truth_table(spark):
    df = spark.createDataFrame([(i, d, h, f) for i, (d, h, f, _) in enumerate(TRUTH)], "i int, deliveryDate string, start_hour int, DSTFlag boolean")
    got = {r.i: r.utc_ts for r in tc.with_utc(df.withColumn("deliveryDate", F.to_date("deliveryDate"))).collect()}
    assert got == {i: D(t[3]) for i, t in enumerate(TRUTH)}


def test_gap_with_minutes_moves_to_first_valid_instant(spark):
    df = spark.createDataFrame([("2024-03-10", 2, False)], "deliveryDate string, start_hour int, DSTFlag boolean")
    assert tc.with_utc(df, minutes=F.lit(30)).first().utc_ts == D("2024-03-10 08:00")


def test_quarter_offset_comes_after_localising(spark):
    df = spark.createDataFrame([("2024-11-03", 2, 3, "LZ_A", "LZ", 1.0, True)],
                               "deliveryDate string, deliveryHour int, deliveryInterval int, settlementPoint string, settlementPointType string, settlementPointPrice double, DSTFlag boolean")
    r = etl.normalise_rt(df).first()
    assert (r.utc_ts, r.local_ts) == (D("2024-11-03 07:30"), D("2024-11-03 01:30"))


def test_hour_ending(spark):
    df = spark.createDataFrame([("24:00", 1), ("01:00", 24), ("none", 5)], "s string, n int")
    assert [tuple(r) for r in df.select(tc.hour_ending_to_start("s"), tc.delivery_hour_to_start("n")).collect()] == [(23, 0), (0, 23), (None, 4)]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(25,)], "n int").select(tc.delivery_hour_to_start("n")).collect()


def test_scalars(spark):
    e = 2.718281828459045
    df = spark.createDataFrame([(0.0,), (e - 1,), (-(e - 1),), (None,), (1e6,), (-3.25,)], "x double")
    got = df.select(c.signed_log("x").alias("s"), c.inverse_signed_log(c.signed_log("x")).alias("b"), c.signed_log("x", True).alias("z"), "x").collect()
    assert [r.s for r in got[:3]] == pytest.approx([0, 1, -1]) and got[3].s is None and got[0].z is None
    assert all(r.b == pytest.approx(r.x) for r in got if r.x is not None)


def test_moments_and_normal_quantile(spark):
    from statistics import NormalDist

    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 9, 4)], "x double")
    r = df.agg(c.skew_of("x").alias("s"), c.kurtosis_of("x").alias("k")).first()
    assert (r.s, r.k) == (pytest.approx(1.806619, abs=1e-6), pytest.approx(3.549136, abs=1e-6))
    ps = [1e-6, 0.001, 0.02, 0.1, 0.5, 0.77, 0.98, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(c.normal_ppf("p").alias("q")).collect()
    assert [r.q for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-7, abs=1e-8)


def test_posting_window_clamps_at_midnight(spark):
    df = spark.createDataFrame([("2024-01-05 00:30:00",), ("2024-01-05 01:00:00",), ("2024-01-05 01:01:00",)], "p string").select(F.to_timestamp("p").alias("p"))
    assert [r[0] for r in df.select(tc.posting_window("p", 1, 0, 3)).collect()] == [True, True, False]


def test_payload_documents(spark, tmp_path):
    doc = {"_meta": "m", "fields": [{"name": "a", "dataType": "INTEGER"}], "data": [["1"], ["x"]]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    df = payload.read_payloads(spark, str(tmp_path), doc["fields"])
    assert df.dtypes == [("a", "bigint")] and [r.a for r in df.collect()] == [1, None]
    (tmp_path / "a.json").write_text(json.dumps({"_meta": "m", "fields": doc["fields"], "data": []}))
    assert payload.read_payloads(spark, str(tmp_path), doc["fields"]).count() == 0
    (tmp_path / "a.json").write_text(json.dumps({"_meta": "m"}))
    with pytest.raises(Exception, match="payload lacks"):
        payload.read_payloads(spark, str(tmp_path), doc["fields"]).collect()


def test_payload_values_follow_the_documents_own_fields(spark, tmp_path):
    kinds = [{"name": "a", "dataType": "INTEGER"}, {"name": "b", "dataType": "INTEGER"}]
    (tmp_path / "x.json").write_text(json.dumps({"_meta": "m", "fields": kinds[::-1], "data": [["1", "2"]]}))
    (tmp_path / "y.json").write_text(json.dumps({"_meta": "m", "fields": kinds, "data": [["3", "4"]]}))
    assert sorted(map(tuple, payload.read_payloads(spark, str(tmp_path), kinds).collect())) == [(2, 1), (3, 4)]
    with pytest.raises(Exception, match="no field c"):
        payload.read_payloads(spark, str(tmp_path), [*kinds, {"name": "c", "dataType": "INTEGER"}]).collect()


def test_daily_files_follow_dates(spark, tmp_path):
    df = spark.createDataFrame([(D("2024-01-01 00:00") + dt.timedelta(hours=h), float(h)) for h in range(24 * 6)], "utc_ts timestamp, price double").repartition(30)
    tables.write_daily(df, F.to_date("utc_ts"), str(tmp_path / "d"), files_per_date=2)
    assert len(list((tmp_path / "d").rglob("*.parquet"))) <= 12
    assert spark.read.parquet(str(tmp_path / "d")).groupBy("extract_date").count().where("count = 24").count() == 6


def test_records(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "r.json").write_text(json.dumps({"_meta": "m", "data": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]}))
    df = payload.read_records(spark, str(tmp_path), T.StructType().add("a", "long").add("b", "string"))
    assert sorted(r.a for r in df.collect()) == [1, 2]


def test_layer_round_trip_and_csv_scan(spark, tmp_path):
    rows = [("A", "LZ", D("2024-01-01 00:00"), 1.5), ("A", "LZ", D("2024-02-01 00:00"), 2.5), ("B", "LZ", D("2024-01-01 00:00"), -1.0)]
    df = spark.createDataFrame(rows, "location string, location_type string, utc_ts timestamp, price double")
    tables.write_layer(df, str(tmp_path / "p"), files_per_span=2)
    assert sorted(spark.read.parquet(str(tmp_path / "p")).select("location", "price").collect()) == [("A", 1.5), ("A", 2.5), ("B", -1.0)]
    assert tables.scan_model_input(spark, str(tmp_path / "p"), "A_LZ").count() == 2
    raw = spark.createDataFrame([("2024-01-01", "01:00", "LZ_A", 5.0, False, "2024-01-01 06:00:00", "2024-01-01 00:00:00")],
                                "deliveryDate string, hourEnding string, settlementPoint string, settlementPointPrice double, DSTFlag boolean, utc_ts string, local_ts string")
    raw.write.csv(str(tmp_path / "raw" / "dam_spp"), header=True)
    r = tables.scan_raw(spark, str(tmp_path / "raw"), "dam_spp").first()
    assert (r.settlementPointPrice, r.utc_ts) == (5.0, D("2024-01-01 06:00"))
    with pytest.raises(KeyError):
        tables.scan_raw(spark, str(tmp_path), "nope")
    with pytest.raises(ValueError, match="lacks columns"):
        contracts.require_columns(df, ["week_num"])


def test_zone_contract_sizes():
    assert (len(contracts.LOAD_ZONES), len(contracts.WIND_ZONES), len(contracts.SOLAR_ZONES)) == (8, 25, 29)


def test_melt_then_pivot_is_identity(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "id int, a double, b double")
    back = clean.melt_zones(df, ["id"], ["a", "b"], "v").groupBy("id").pivot("location", ["a", "b"]).agg(F.first("v"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_completeness_fails_only_on_interior_gaps(spark):
    full = [D("2024-01-01 00:00") + dt.timedelta(hours=h) for h in range(24 * 4)]
    mk = lambda ts: spark.createDataFrame([("A", t) for t in ts], "location string, utc_ts timestamp")
    edge = mk(full[5:-3])
    gap = mk(full[:30] + full[31:])
    absent = mk(full[:24] + full[72:])
    assert clean.completeness(edge, ["location"]).first().complete
    assert not clean.completeness(gap).first().complete
    r = clean.completeness(absent).first()
    assert (r.n_absent_days, r.complete) == (2, False)


def test_etl_reports_failures(spark):
    cols = "deliveryDate string, hourEnding string, settlementPoint string, settlementPointPrice double, DSTFlag boolean"
    rows = [(f"2024-01-0{d}", f"{h:02d}:00", "LZ_A", 1.0, False) for d in (1, 2, 3, 4) for h in range(1, 25)]
    ok = etl.etl_dam(spark.createDataFrame(rows, cols))
    assert ok.require_valid() is ok
    bad = etl.etl_dam(spark.createDataFrame([r for r in rows if not (r[0] == "2024-01-02" and r[1] == "10:00")] + [("2024-01-02", "10:00", "LZ_A", None, False)], cols))
    assert bad.failures() == ["keys_present"]
    with pytest.raises(ValueError):
        bad.require_valid()


def test_forecast_etl_load_keeps_nulls_and_filters_flag(spark):
    df = spark.createDataFrame([(D("2024-01-01 05:00"), "2024-01-02", "01:00", 1.0, None, True, False), (D("2024-01-01 05:00"), "2024-01-02", "01:00", 9.0, 9.0, None, False)],
                               "postedDatetime timestamp, deliveryDate string, hourEnding string, coast double, east double, inUseFlag boolean, DSTFlag boolean")
    load = etl.etl_forecast(df, ["coast", "east"], "load_forecast", load=True)
    assert load.clean.count() == 2 and load.failures() == ["keys_present"]
    assert etl.etl_forecast(df, ["coast", "east"], "wind_generation").clean.count() == 3


def test_holiday_rules(spark):
    days = ["2024-01-01", "2024-05-27", "2024-11-28", "2024-11-29", "2024-03-29", "2021-12-31", "2024-06-19", "2020-06-18", "2023-01-02", "2024-07-05", "2024-03-02"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", calendar.holiday_names(F.to_date("d")).alias("n"))
    got = {r.d: r.n for r in df.collect()}
    assert got["2024-01-01"] == "New Year's Day" and got["2024-05-27"] == "Memorial Day" and got["2024-11-28"] == "Thanksgiving Day"
    assert got["2024-03-29"] == "Good Friday" and got["2021-12-31"] == "New Year's Day (observed)" and got["2023-01-02"] == "New Year's Day (observed)"
    assert "Juneteenth" in got["2024-06-19"] and got["2020-06-18"] is None and got["2024-07-05"] is None and got["2024-03-02"] == "Texas Independence Day"


def test_holiday_distance_padding(spark):
    df = spark.createDataFrame([(D("2024-12-30 00:00"),)], "utc_ts timestamp")
    padded, as_published = calendar.holiday_features(df).first(), calendar.holiday_features(df, pad_years=0).first()
    assert (padded.etf_days_to_holiday, as_published.etf_days_to_holiday) == (2, 365)
    assert padded.etf_days_from_holiday == 4 and padded.etf_is_holiday_week and not padded.etf_is_pre_holiday
