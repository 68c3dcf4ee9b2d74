"""Golden edge rows (FIXTURES.md section 7) on small hand-made frames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac.functions import columns as X
from tarmac.operators.cleaning import clean_flights, removed_rows
from tarmac.operators.drift import ks_drift
from tarmac.operators.encoders import ScalerModel
from tarmac.operators.metrics import class_metrics, confusion
from tarmac.plans.features import ONE_HOT_COLUMNS, one_hot_columns, serving_features


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_time_bins(spark):
    hours = [0, 6, 7, 12, 13, 18, 19, 24, 25]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    got = col_values(df.select(X.time_of_day("h").alias("b")), "b")
    assert got == ["night", "night", "morning", "morning", "afternoon", "afternoon",
                   "evening", "evening", None]


def test_distance_bins(spark):
    ds = [0, 1, 500, 501, 1000, 1001, 2000, 2001, 6000, 6001]
    df = spark.createDataFrame([(d,) for d in ds], "d int")
    got = col_values(df.select(X.distance_group("d").alias("b")), "b")
    assert got == [None, "short", "short", "medium", "medium", "long", "long",
                   "ultra_long", "ultra_long", None]
    open_top = col_values(df.select(X.distance_group("d", open_top=True).alias("b")), "b")
    assert open_top[-1] == "ultra_long"


def test_target_and_flags(spark):
    df = spark.createDataFrame(
        [(15.0, 0, 0), (16.0, 0, 0), (None, 0, 0), (30.0, None, 0), (30.0, 1, 0)],
        "ArrDelay double, Cancelled int, Diverted int")
    out = clean_flights(df)
    assert col_values(out, "is_delayed") == [0, 1, 0]
    r = removed_rows(df).first()
    assert (r["rows_in"], r["rows_out"], r["rows_removed"]) == (5, 3, 2)


def test_hhmm_split(spark):
    df = spark.createDataFrame([(5,), (1430,), (2400,)], "t int")
    got = [(r["h"], r["m"]) for r in df.select(X.hhmm_hour("t").alias("h"),
                                               X.hhmm_minute("t").alias("m")).collect()]
    assert got == [(0, 5), (14, 30), (24, 0)]


def test_elapsed_default(spark):
    req = spark.createDataFrame(
        [("a", 7, 15, 3, 14, 30, "AA", "JFK", "LAX", 2475, 5.0, 18, None),
         ("b", 7, 15, 3, 14, 30, "AA", "JFK", "LAX", 2475, 5.0, 18, 0),
         ("c", 7, 15, 3, 14, 30, "AA", "JFK", "LAX", 2475, 5.0, 18, 330)],
        "request_id string, month int, day_of_month int, day_of_week int, dep_hour int, "
        "dep_minute int, carrier string, origin string, dest string, distance int, "
        "dep_delay double, taxi_out int, crs_elapsed_time int")
    out = serving_features(req, "serving_compat").orderBy("request_id")
    assert col_values(out, "CRSElapsedTime") == [339, 339, 330]


def test_date_from_parts(spark):
    df = spark.createDataFrame([(2024, 2, 30), (2024, 2, 29), (2023, 2, 29)], "y int, m int, d int")
    got = col_values(df.select(X.date_from_parts("y", "m", "d").alias("x")), "x")
    assert got == [None, dt.date(2024, 2, 29), None]


def test_one_hot_fall_night_short_all_zero(spark):
    df = spark.createDataFrame([("night", "fall", "short")], "time_of_day string, season string, "
                                                             "distance_group string")
    row = df.select(*one_hot_columns()).first()
    assert [row[c] for c in ONE_HOT_COLUMNS] == [0] * 9


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = ScalerModel.fit(df, ["a", "b"])
    out = m.transform(df, keep=[])
    assert col_values(out, "b") == [0.0, 0.0, 0.0]
    assert m.stds[0] == pytest.approx((2 / 3) ** 0.5)  # population std


def test_ks_identical_and_disjoint(spark):
    a = spark.createDataFrame([(float(i),) for i in range(50)], "v double")
    b = spark.createDataFrame([(float(i + 100),) for i in range(50)], "v double")
    same = ks_drift(a, a, features=[("v", "v")]).first()
    assert same["ks_statistic"] == 0.0 and same["p_value"] == 1.0 and same["drift"] is False
    apart = ks_drift(a, b, features=[("v", "v")]).first()
    assert apart["ks_statistic"] == 1.0 and apart["drift"] is True


def test_metrics_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = class_metrics(confusion(df)).first()
    assert m["precision"] == 0.0 and m["f1_score"] == 0.0 and m["recall"] == 0.0


def test_unknown_carrier_compat_code(spark):
    req = spark.createDataFrame(
        [("a", 7, 15, 3, 14, 30, "zz", "JFK", "LAX", 2475, 5.0, 18, 330),
         ("b", 7, 15, 3, 14, 30, "dl", "JFK", "LAX", 2475, 5.0, 18, 330)],
        "request_id string, month int, day_of_month int, day_of_week int, dep_hour int, "
        "dep_minute int, carrier string, origin string, dest string, distance int, "
        "dep_delay double, taxi_out int, crs_elapsed_time int")
    out = serving_features(req, "serving_compat").orderBy("request_id")
    assert col_values(out, "carrier_encoded") == [0, 3]
    assert col_values(out, "season_winter") == [0, 0]
    assert col_values(out, "origin_freq")[0] == pytest.approx(1 / 30)


def test_month_name_keyed_by_number(spark):
    df = spark.createDataFrame([(9,), (13,)], "m int")
    assert col_values(df.select(X.month_name("m").alias("n")), "n") == ["Sep", None]


def test_cause_allocation_half_even(spark):
    df = spark.createDataFrame([(50.0,), (10.0,)], "a double")
    got = df.select(X.cause_allocation("a").alias("c")).collect()
    assert list(got[0]["c"]) == [15, 10, 10, 2, 12]   # 2.5 -> 2, 12.5 -> 12
    assert list(got[1]["c"]) == [0, 0, 0, 0, 0]


def test_delay_risk_clip(spark):
    df = spark.createDataFrame([("G4", 15, 7, 6), ("HA", 3, 3, 1)],
                               "c string, h int, m int, d int")
    got = col_values(df.select(F.round(X.delay_risk("c", "h", "m", "d"), 6).alias("r")), "r")
    assert got == [0.42, 0.11]


def test_prefixed_columns(spark):
    from tarmac.plans.features import prefixed_columns
    df = spark.createDataFrame([(1, 0, 1, 0)], "season_spring int, x int, time_of_day_evening int, "
                                               "distance_group_long int")
    assert prefixed_columns(df) == ["season_spring", "time_of_day_evening", "distance_group_long"]
