"""Checked layers, incremental sinks and file sources."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.plans import etl, landing
from spreadlab.sources import files, payload

T0 = dt.datetime(2024, 1, 1)


def quarters(spark, days=3, point="LZ_A", drop=(), price=1.0):
    rows = [((T0 + dt.timedelta(days=d)).date(), h + 1, q + 1, point, "LZ", price + q, False) for d in range(days) for h in range(24) for q in range(4) if (d, h) not in drop]
    return spark.createDataFrame(rows, "deliveryDate date, deliveryHour int, deliveryInterval int, settlementPoint string, settlementPointType string, settlementPointPrice double, DSTFlag boolean")


def test_layer_lands_and_a_failing_check_leaves_the_old_one(spark, tmp_path):
    path = f"{tmp_path}/layer"
    schema = etl.land_rt(quarters(spark), path)
    first = spark.read.schema(schema).parquet(path)
    assert first.count() == 72 and first.agg(F.max("price_mean")).first()[0] == 2.5
    etl.land_rt(quarters(spark, price=11.0), path)
    assert spark.read.schema(schema).parquet(path).agg(F.max("price_mean")).first()[0] == 12.5
    # An hour of the second day is absent; then no rows; then a blank type.
    blank = quarters(spark, price=7.0).withColumn("settlementPointType", F.lit(" "))
    for raw, name in ((quarters(spark, price=7.0, drop={(1, 5)}), "short_days"), (quarters(spark).limit(0), "n_rows"), (blank, "location_type_blank")):
        with pytest.raises(landing.ChecksFailed) as failed:
            etl.land_rt(raw, path)
        assert name in failed.value.found
    assert spark.read.schema(schema).parquet(path).agg(F.max("price_mean")).first()[0] == 12.5
    assert os.listdir(tmp_path) == ["layer"]


def test_checks_count_offending_rows_in_the_scan_that_writes(spark, tmp_path):
    rows = spark.createDataFrame([(T0, "LZ_A", 1.0), (T0, "XX_B", None), (None, None, 2.0)], "utc_ts timestamp, location string, price double")
    checks = landing.key_checks(["utc_ts", "price"]) | landing.domain_checks("location", prefixes=["LZ_"])
    with pytest.raises(landing.ChecksFailed) as failed:
        landing.land(rows, f"{tmp_path}/x", checks)
    assert failed.value.found == {"keys_absent": 2, "location_outside": 2} and os.listdir(tmp_path) == []
    assert landing.land(rows.where("location = 'LZ_A'"), f"{tmp_path}/x", checks) == {"n_rows": 1, "keys_absent": 0, "location_outside": 0, "short_days": 0}


def test_rewriting_a_date_touches_one_folder(spark, tmp_path):
    path = f"{tmp_path}/dates"
    rows = spark.createDataFrame([(T0 + dt.timedelta(hours=7 * k), float(k)) for k in range(20)], "utc_ts timestamp, v double")
    landing.replace_dates(rows, F.to_date("utc_ts"), path)
    seen = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/extract_date=*/*.parquet")}
    before = seen()
    landing.replace_dates(rows.where(F.to_date("utc_ts") == "2024-01-03").withColumn("v", -F.col("v")), F.to_date("utc_ts"), path)
    after = seen()
    assert {p.split("/")[-2] for p in set(before) ^ set(after)} == {"extract_date=2024-01-03"}
    assert {p: t for p, t in after.items() if p in before} == {p: t for p, t in before.items() if "2024-01-03" not in p}
    assert spark.read.parquet(path).where("v < 0").count() == rows.where(F.to_date("utc_ts") == "2024-01-03").count()


def test_keep_last_counts_the_removed(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("a", 2, 7), ("b", 1, None), (None, 1, 2), (None, 2, 1)], "k string, o int, v int")
    assert {tuple(r) for r in landing.keep_last(df, ["k"], ["o"]).select("k", "o", "v", "n_removed").collect()} == {("a", 3, 6, 2), ("b", 1, None, 0), (None, 2, 1, 1)}
    new = spark.createDataFrame([("a", 4, 8), ("c", 1, 1)], "k string, o int, v int")
    assert {tuple(r) for r in landing.merge_table(df, new, ["k"], ["o"]).collect()} == {("a", 4, 8), ("b", 1, None), (None, 2, 1), ("c", 1, 1)}


def test_one_path_exactly(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="0 paths"):
        files.the_one(spark, f"{tmp_path}/rt_spp*")
    for name in ("rt_spp_1.csv", "_rt_spp_hidden.csv"):
        (tmp_path / name).write_text("deliveryDate\n")
    assert files.the_one(spark, f"{tmp_path}/*rt_spp*").endswith("rt_spp_1.csv")
    (tmp_path / "rt_spp_2.csv").write_text("deliveryDate\n")
    with pytest.raises(FileNotFoundError, match="2 paths"):
        files.scan_dataset(spark, str(tmp_path), "rt_spp")
    with pytest.raises(KeyError):
        files.scan_dataset(spark, str(tmp_path), "unknown")


def test_csv_keeps_broken_records_apart(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_csv(spark, f"{tmp_path}/none.csv", "a int, b double")
    (tmp_path / "x.csv").write_text("a,b\n1,2.5\nz,1.0\n3,4.0,extra\n")
    rows = files.scan_csv(spark, f"{tmp_path}/x.csv", "a int, b double")
    assert [tuple(r) for r in files.sound(rows).collect()] == [(1, 2.5)]
    assert [tuple(r) for r in files.record_counts(rows).collect()] == [("x.csv", 3, 2, 5)]


def test_study_inputs_have_to_be_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_study(spark, str(tmp_path))


def test_empty_data_gives_an_empty_typed_table(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"_meta": {}, "fields": [{"name": "a", "dataType": "INTEGER"}], "data": []}))
    rows = payload.read_payloads(spark, f"{tmp_path}/d.json", [{"name": "a", "dataType": "INTEGER"}])
    assert rows.count() == 0 and rows.dtypes == [("a", "bigint")]
    (tmp_path / "r.json").write_text(json.dumps({"_meta": {}, "data": []}))
    rows = payload.read_records(spark, f"{tmp_path}/r.json", T.StructType([T.StructField("a", T.LongType())]))
    assert rows.count() == 0 and rows.dtypes == [("a", "bigint")]
