"""Registered queries: one per operator of the inventory, each with its SQL twin.

Inputs are always the driver's tables (or what Spark derives from them), read
whole; every query is a lazy DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tarmac import oracle as O
from tarmac.catalog import register
from tarmac.functions import columns as X
from tarmac.functions import constants as K
from tarmac.operators import aggregates as A
from tarmac.operators.cleaning import clean_flights, removed_rows
from tarmac.sources import testdata as T


@T.per_session
def cleaned(spark, sf):
    df = clean_flights(T.flights_raw(spark, sf))
    return df.withColumns({"dep_hour": X.hhmm_hour("CRSDepTime"),
                           "dep_minute": X.hhmm_minute("CRSDepTime")})


# --- step 1: dashboard aggregates -------------------------------------------

@register("delay_rate_by_carrier", O.flights_sql("""
SELECT Reporting_Airline, round(avg(is_delayed), 9) AS delay_rate, count(*) AS flights
FROM cf GROUP BY Reporting_Airline"""))
def delay_rate_by_carrier(spark, sf):
    return A.delay_rate_by(cleaned(spark, sf), "Reporting_Airline")


@register("delay_rate_by_hour", O.flights_sql("""
SELECT dep_hour, round(avg(is_delayed), 9) AS delay_rate, count(*) AS flights
FROM cf GROUP BY dep_hour"""))
def delay_rate_by_hour(spark, sf):
    return A.delay_rate_by(cleaned(spark, sf), "dep_hour")


@register("delay_rate_by_month", O.flights_sql(f"""
SELECT Month, round(avg(is_delayed), 9) AS delay_rate, count(*) AS flights, {K.MONTH_NAMES}[Month] AS month_name
FROM cf GROUP BY Month"""))
def delay_rate_by_month(spark, sf):
    return A.delay_rate_by_month(cleaned(spark, sf))


@register("delay_rate_overall", O.flights_sql("""
SELECT round(avg(is_delayed), 9) AS delay_rate FROM cf"""))
def delay_rate_overall(spark, sf):
    return A.delay_rate(cleaned(spark, sf))


@register("table_summary", O.flights_sql("""
SELECT count(*) AS total_flights, round(avg(is_delayed), 9) AS delay_rate,
  round(avg(CASE WHEN is_delayed = 1 THEN ArrDelay END), 9) AS avg_delay,
  count(DISTINCT Reporting_Airline) AS carriers, count(DISTINCT Origin) AS airports
FROM cf"""))
def table_summary(spark, sf):
    return A.table_summary(cleaned(spark, sf))


@register("dashboard_kpis", O.flights_sql("""
SELECT count(*) AS total_flights, round(avg(is_delayed), 9) AS delay_rate,
  round(avg(DepDelay), 9) AS avg_dep_delay, count(DISTINCT Reporting_Airline) AS carriers
FROM cf"""))
def dashboard_kpis(spark, sf):
    return A.dashboard_kpis(cleaned(spark, sf))


@register("value_shares", O.flights_sql("""
SELECT 'Origin' AS "column", Origin AS value, count(*) AS n,
  count(*) / sum(count(*)) OVER () AS share
FROM cf WHERE Origin IS NOT NULL GROUP BY Origin
UNION ALL
SELECT 'Dest', Dest, count(*), count(*) / sum(count(*)) OVER ()
FROM cf WHERE Dest IS NOT NULL GROUP BY Dest"""))
def value_shares(spark, sf):
    return A.value_shares(cleaned(spark, sf), ["Origin", "Dest"])


@register("distinct_counts", O.flights_sql("""
SELECT count(DISTINCT Reporting_Airline) AS distinct_Reporting_Airline,
  count(DISTINCT Origin) AS distinct_Origin, count(DISTINCT Dest) AS distinct_Dest
FROM cf"""))
def distinct_counts(spark, sf):
    return A.distinct_counts(cleaned(spark, sf), ["Reporting_Airline", "Origin", "Dest"])


# --- step 2: cleaning and column operators ----------------------------------

@register("removed_rows", O.flights_sql("""
SELECT count(*) AS rows_in,
  count(*) FILTER (WHERE Cancelled = 0 AND Diverted = 0) AS rows_out,
  count(*) - count(*) FILTER (WHERE Cancelled = 0 AND Diverted = 0) AS rows_removed
FROM flights_raw"""))
def removed_rows_q(spark, sf):
    return removed_rows(T.flights_raw(spark, sf))


@register("clean_flights", O.flights_sql("""
SELECT flight_key, Reporting_Airline, Origin, Dest, ArrDelay, TaxiOut, CRSElapsedTime,
  ActualElapsedTime, is_delayed FROM cf"""))
def clean_flights_q(spark, sf):
    return clean_flights(T.flights_raw(spark, sf)).select(
        "flight_key", "Reporting_Airline", "Origin", "Dest", "ArrDelay", "TaxiOut",
        "CRSElapsedTime", "ActualElapsedTime", K.TARGET)


@register("time_bins", O.flights_sql(f"""
SELECT dep_hour, {O._TOD} AS time_of_day, count(*) AS flights FROM cf GROUP BY ALL"""))
def time_bins(spark, sf):
    df = cleaned(spark, sf)
    return df.groupBy("dep_hour", X.time_of_day("dep_hour").alias("time_of_day")) \
             .agg(F.count(F.lit(1)).alias("flights"))


@register("distance_bins", O.flights_sql(f"""
SELECT {O._DG} AS distance_group, count(*) AS flights,
  min(Distance) AS min_distance, max(Distance) AS max_distance FROM cf GROUP BY ALL"""))
def distance_bins(spark, sf):
    df = cleaned(spark, sf)
    return df.groupBy(X.distance_group("Distance").alias("distance_group")).agg(
        F.count(F.lit(1)).alias("flights"),
        F.min("Distance").alias("min_distance"), F.max("Distance").alias("max_distance"))


@register("season", O.flights_sql(f"""
SELECT Month, {O._SEASON} AS season, count(*) AS flights FROM cf GROUP BY ALL"""))
def season_q(spark, sf):
    df = cleaned(spark, sf)
    return df.groupBy("Month", X.season("Month").alias("season")).agg(F.count(F.lit(1)).alias("flights"))


@register("hhmm_split", O.flights_sql("""
SELECT CRSDepTime, dep_hour, dep_minute, count(*) AS flights FROM cf GROUP BY ALL"""))
def hhmm_split(spark, sf):
    df = cleaned(spark, sf)
    return df.groupBy("CRSDepTime", "dep_hour", "dep_minute").agg(F.count(F.lit(1)).alias("flights"))


@register("date_parts", O.flights_sql("""
SELECT Year, Month, DayofMonth + 3 AS day,
  CAST(floor((Month - 1) / 3) + 1 AS INT) AS quarter,
  try_cast(printf('%04d-%02d-%02d', Year, Month, DayofMonth + 3) AS DATE) AS shifted_date,
  count(*) AS flights
FROM flights_raw GROUP BY ALL"""))
def date_parts(spark, sf):
    """R1 + R2 on the flight calendar parts, with the day moved 3 ahead so that
    impossible dates (Feb 30, Apr 31, day 34) occur and become null."""
    raw = T.flights_raw(spark, sf)
    day = (F.col("DayofMonth") + 3).alias("day")
    return (raw.groupBy("Year", "Month", day)
               .agg(F.count(F.lit(1)).alias("flights"))
               .withColumn("quarter", X.quarter_of_month("Month"))
               .withColumn("shifted_date", X.date_from_parts("Year", "Month", "day")))


@register("valid_dates", O.flights_sql("""
SELECT count(*) AS rows_in,
  count(try_cast(printf('%04d-%02d-%02d', Year, Month, DayofMonth + 3) AS DATE)) AS rows_kept
FROM flights_raw"""))
def valid_dates(spark, sf):
    """R2 'then dropped': rows whose shifted date is impossible are removed."""
    raw = T.flights_raw(spark, sf).withColumn(
        "shifted_date", X.date_from_parts("Year", "Month", F.col("DayofMonth") + 3))
    # One pass: count(shifted_date) is the row count after dropna(subset=[date]).
    return raw.agg(F.count(F.lit(1)).alias("rows_in"),
                   F.count("shifted_date").alias("rows_kept"))


@register("clamp_minutes", O.flights_sql("""
SELECT flight_key, DepDelay, DepDelayMinutes, ArrDelay, ArrDelayMinutes FROM flights_raw"""))
def clamp_minutes(spark, sf):
    return T.flights_raw(spark, sf).select("flight_key", "DepDelay", "DepDelayMinutes",
                                           "ArrDelay", "ArrDelayMinutes")


_RISK_SQL = (
    f"round(least(greatest({K.RISK_BASE}e0 + coalesce(CASE Reporting_Airline "
    + " ".join(f"WHEN '{c}' THEN {x}e0" for c, x in K.CARRIER_RISK.items()) + " END, 0e0)"
    + f" + CASE WHEN dep_hour BETWEEN 14 AND 20 THEN {K.RISK_AFTERNOON}e0 ELSE 0e0 END"
    + f" + CASE WHEN dep_hour < 9 THEN {K.RISK_EARLY}e0 ELSE 0e0 END"
    + f" + CASE WHEN Month IN ({', '.join(map(str, K.RISK_PEAK_MONTHS))}) THEN {K.RISK_PEAK}e0 ELSE 0e0 END"
    + f" + CASE WHEN DayOfWeek >= 6 THEN {K.RISK_WEEKEND}e0 ELSE 0e0 END, {K.RISK_CLIP[0]}e0), {K.RISK_CLIP[1]}e0), 9)")


@register("risk_score", O.flights_sql(f"""
SELECT flight_key, {_RISK_SQL} AS delay_risk FROM cf"""))
def risk_score(spark, sf):
    df = cleaned(spark, sf)
    return df.select("flight_key", F.round(X.delay_risk(), 9).alias("delay_risk"))


@register("cause_allocation", O.flights_sql("""
SELECT flight_key, ArrDelay, CarrierDelay, WeatherDelay, NASDelay, SecurityDelay,
  LateAircraftDelay FROM flights_raw"""))
def cause_allocation(spark, sf):
    return T.flights_raw(spark, sf).select("flight_key", "ArrDelay", *K.CAUSE_COLUMNS)


@register("elapsed_parts", O.flights_sql("""
SELECT flight_key, TaxiOut, AirTime, TaxiIn, ActualElapsedTime, CRSElapsedTime FROM flights_raw"""))
def elapsed_parts(spark, sf):
    return T.flights_raw(spark, sf).select("flight_key", "TaxiOut", "AirTime", "TaxiIn",
                                           "ActualElapsedTime", "CRSElapsedTime")


@register("endpoint_check", O.flights_sql("""
SELECT Origin, count(*) AS flights, count(*) FILTER (WHERE Origin = Dest) AS same_endpoints
FROM flights_raw GROUP BY Origin"""))
def endpoint_check(spark, sf):
    """Per origin, how many rows break the different-endpoints rule."""
    raw = T.flights_raw(spark, sf)
    return raw.groupBy("Origin").agg(
        F.count(F.lit(1)).alias("flights"),
        F.count_if(F.col("Origin") == F.col("Dest")).alias("same_endpoints"))


@register("dataset_summary", O.flights_sql("""
SELECT count(*) AS rows, 28 AS columns, round(avg(CAST(ArrDelay > 15 AS INT)), 9) AS delay_rate,
  count(DISTINCT Reporting_Airline) AS carriers, count(DISTINCT Origin) AS origins,
  count(DISTINCT Dest) AS dests, min(FlightDate) AS first_date, max(FlightDate) AS last_date
FROM flights_raw"""))
def dataset_summary(spark, sf):
    return A.dataset_summary(T.flights_raw(spark, sf, with_key=False))


@register("extract_profile", O.flights_sql("""
SELECT count(*) AS rows, 28 AS columns, min(FlightDate) AS first_date, max(FlightDate) AS last_date,
  count(DISTINCT Reporting_Airline) AS carriers FROM flights_raw"""))
def extract_profile(spark, sf):
    return A.extract_profile(T.flights_raw(spark, sf, with_key=False))


def _csv_of_flights(spark, sf):
    """The raw flights as CSV, columns reversed, without AirTime, TaxiOut written as 15.0."""
    from tarmac.session import shared_path
    raw = T.flights_raw(spark, sf, with_key=False).drop("AirTime").withColumn("TaxiOut", F.col("TaxiOut").cast("double"))
    path = shared_path(spark, "csv", unique=True)
    raw.select(*reversed(raw.columns)).write.option("header", True).csv(path)
    return path


@register("column_contract", "SELECT unnest([" + ", ".join(f"'{c}'" for c in K.RAW_COLUMNS)
          + "]) AS column_name, unnest([" + ", ".join(str(c != "AirTime").lower() for c in K.RAW_COLUMNS) + "]) AS present")
def column_contract(spark, sf):
    """A2 over the header of a CSV that lacks one expected column."""
    from tarmac.sources.files import column_contract as contract, read_raw_csv
    return contract(read_raw_csv(spark, _csv_of_flights(spark, sf)), K.RAW_COLUMNS)


@register("csv_roundtrip", O.flights_sql("""
SELECT Reporting_Airline, count(*) AS flights, CAST(sum(Year) AS BIGINT) AS sum_year,
  CAST(sum(TaxiOut) AS BIGINT) AS sum_taxi_out, CAST(sum(Distance) AS BIGINT) AS sum_distance,
  CAST(sum(Cancelled) AS BIGINT) AS cancelled, min(FlightDate) AS first_date, max(Origin) AS last_origin
FROM flights_raw GROUP BY Reporting_Airline"""))
def csv_roundtrip(spark, sf):
    """A1: a CSV with reordered columns, one missing and one float-form integer, bound by name."""
    from tarmac.sources.files import read_raw_csv
    return read_raw_csv(spark, _csv_of_flights(spark, sf)).groupBy("Reporting_Airline").agg(
        F.count(F.lit(1)).alias("flights"), F.sum("Year").alias("sum_year"),
        F.sum("TaxiOut").alias("sum_taxi_out"), F.sum("Distance").alias("sum_distance"),
        F.sum("Cancelled").alias("cancelled"), F.min("FlightDate").alias("first_date"),
        F.max("Origin").alias("last_origin"))


# --- step 3: encoders and the full transform --------------------------------

@T.per_session
def category_model(spark, sf):
    """Fitted once per session and input (the fitted table is checkpointed)."""
    from tarmac.operators.encoders import CategoryModel
    return CategoryModel.fit(cleaned(spark, sf))


@T.per_session
def processed(spark, sf, keep_key: bool = True):
    from tarmac.plans.features import transform
    df, _model = transform(T.flights_raw(spark, sf), model=category_model(spark, sf),
                           keep_key=keep_key)
    return df


@register("label_codes", O.flights_sql("""
SELECT v AS Reporting_Airline, carrier_encoded FROM codes""", processed=True))
def label_codes(spark, sf):
    """Carrier -> 0-based code in sorted order of the carriers left after cleaning."""
    m = category_model(spark, sf)
    return m.lookup("carrier", "Reporting_Airline", {"code": "carrier_encoded"})


@register("share_codes", O.flights_sql("""
SELECT 'origin' AS kind, v AS value, origin_freq AS share FROM osh
UNION ALL SELECT 'dest', v, dest_freq FROM dsh""", processed=True))
def share_codes(spark, sf):
    m = category_model(spark, sf)
    return m.table.filter(F.col("kind") != "carrier").select("kind", "value", "share")


@register("one_hot", O.flights_sql("""
SELECT flight_key, time_of_day_morning, time_of_day_afternoon, time_of_day_evening,
  season_spring, season_summer, season_winter, distance_group_medium, distance_group_long,
  distance_group_ultra_long FROM pf""", processed=True))
def one_hot(spark, sf):
    from tarmac.plans.features import ONE_HOT_COLUMNS
    return processed(spark, sf).select("flight_key", *ONE_HOT_COLUMNS)


def _scaler_sql():
    from tarmac.plans.features import FEATURES
    parts = [f"SELECT '{c}' AS feature, round(avg({c}), 9) AS mean, "
             f"round(stddev_pop({c}), 9) AS std, "
             f"round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 9) AS scale "
             f"FROM pf" for c in FEATURES]
    return O.flights_sql("\nUNION ALL\n".join(parts), processed=True)


@register("scaled_features", _scaler_sql())
def scaled_features(spark, sf):
    """E4 fitted state: per feature mean, population std and the divisor used."""
    from tarmac.operators.encoders import ScalerModel
    from tarmac.plans.features import FEATURES
    m = ScalerModel.fit(processed(spark, sf, keep_key=False), FEATURES)
    return m.to_frame(spark).select(
        "feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"),
        F.round("scale", 9).alias("scale"))


def _features_full_sql():
    from tarmac.plans.features import PROCESSED_COLUMNS
    cols = ["flight_key"] + [("round(log_distance, 9) AS log_distance" if c == "log_distance" else c)
                             for c in PROCESSED_COLUMNS]
    return O.flights_sql("SELECT " + ", ".join(cols) + " FROM pf", processed=True)


@register("features_full", _features_full_sql())
def features_full(spark, sf):
    """The whole 32-column processed table (plus the row key)."""
    df = processed(spark, sf)
    return df.withColumn("log_distance", F.round("log_distance", 9))


@register("carrier_names", O.flights_sql("""
SELECT Reporting_Airline, n.carrier_name, round(avg(is_delayed), 9) AS delay_rate,
  count(*) AS flights
FROM cf LEFT JOIN (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in K.CARRIER_NAMES.items())
+ """) n(code, carrier_name) ON cf.Reporting_Airline = n.code
GROUP BY ALL"""))
def carrier_names(spark, sf):
    """Delay rate by carrier with the carrier's name from the carrier dimension."""
    from tarmac.operators.joins import lookup_join
    dim = spark.createDataFrame(list(K.CARRIER_NAMES.items()),
                                "Reporting_Airline string, carrier_name string")
    rates = A.delay_rate_by(cleaned(spark, sf), "Reporting_Airline")
    return lookup_join(rates, dim, "Reporting_Airline", "left", dim_rows=len(K.CARRIER_NAMES))


# --- step 5: prediction log ---------------------------------------------------

def plog_sql(body: str) -> str:
    return O.with_ctes(O.PREDICTION_LOG) + body


@register("log_kpis", plog_sql("""
SELECT count(*) AS total_predictions, round(avg(prediction), 9) AS delayed_rate,
  round(avg(probability), 9) AS avg_probability FROM plog"""))
def log_kpis(spark, sf):
    return A.log_kpis(T.prediction_log(spark, sf))


@register("prediction_stats", plog_sql("""
SELECT count(*) AS total_predictions, round(avg(prediction), 9) AS delayed_rate,
  round(avg(probability), 9) AS avg_probability, min(timestamp) AS first_prediction,
  max(timestamp) AS last_prediction FROM plog"""))
def prediction_stats(spark, sf):
    return A.prediction_stats(T.prediction_log(spark, sf))


@register("log_by_carrier", plog_sql("""
SELECT carrier, count(*) AS predictions FROM plog GROUP BY carrier"""))
def log_by_carrier(spark, sf):
    return A.predictions_by_carrier(T.prediction_log(spark, sf))


@register("log_history", plog_sql("""
SELECT *, (SELECT count(*) FROM plog) AS total
FROM (SELECT * FROM plog ORDER BY event_id DESC LIMIT 50)"""))
def log_history(spark, sf):
    from tarmac.operators.topk import history
    return history(T.prediction_log(spark, sf), 50)


@register("log_recent", plog_sql("""
SELECT * FROM plog ORDER BY event_id DESC LIMIT 20"""))
def log_recent(spark, sf):
    from tarmac.operators.topk import recent
    return recent(T.prediction_log(spark, sf), 20)


def _hist_sql(source: str, value: str, by: str | None = None) -> str:
    by_sel = f", {by}" if by else ""
    return f"""
, b AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source})
, h AS (
  SELECT CAST(CASE WHEN hi > lo THEN least(29, floor(({value} - lo) * 30 / (hi - lo))) ELSE 0 END AS INT)
    AS bin{by_sel}, lo, hi
  FROM {source}, b WHERE {value} IS NOT NULL)
SELECT bin{by_sel}, count(*) AS n,
  round(lo + bin * (CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1 END), 9) AS bin_start,
  round(lo + (bin + 1) * (CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1 END), 9) AS bin_end
FROM h GROUP BY ALL"""


@register("prob_histogram", O.with_ctes(O.PREDICTION_LOG).rstrip() + _hist_sql("plog", "probability"))
def prob_histogram(spark, sf):
    return A.histogram(T.prediction_log(spark, sf), "probability", 30)


@register("distance_histogram", O.flights_sql("").rstrip() + _hist_sql("cf", "Distance", "is_delayed"))
def distance_histogram(spark, sf):
    return A.histogram(cleaned(spark, sf), "Distance", 30, by=K.TARGET)


# --- step 6: requests, labels, split, metrics -----------------------------------

def req_sql(body: str, processed: bool = False) -> str:
    parts = [O.FLIGHTS_RAW, O.CLEAN] + ([O.PROCESSED] if processed else []) + [O.REQUESTS]
    return O.with_ctes(*parts) + body


@register("request_validation", req_sql("""
SELECT request_id, reasons, reasons = '' AS valid FROM chk"""))
def request_validation(spark, sf):
    from tarmac.operators.requests import validate
    return validate(T.score_requests(spark, sf)).select("request_id", "reasons", "valid")


def _request_features_sql():
    return req_sql("""
SELECT request_id, month AS Month, day_of_month AS DayofMonth, day_of_week AS DayOfWeek,
  dep_hour, coalesce(dep_minute, 0) AS dep_minute,
  coalesce(codes.carrier_encoded, 0) AS carrier_encoded,
  CAST(coalesce(osh.origin_freq, 0) AS DOUBLE) AS origin_freq,
  CAST(coalesce(dsh.dest_freq, 0) AS DOUBLE) AS dest_freq,
  distance AS Distance, round(ln(1 + distance), 9) AS log_distance,
  CAST(day_of_week >= 6 AS INT) AS is_weekend,
  CAST(coalesce(dep_delay, 0) > 0 AS INT) AS dep_delay_flag,
  CAST(coalesce(dep_delay, 0) AS DOUBLE) AS DepDelay, coalesce(taxi_out, 15) AS TaxiOut,
  CAST(coalesce(nullif(crs_elapsed_time, 0), CAST(trunc(distance / 8 + 30) AS INT)) AS INT) AS CRSElapsedTime,
  CAST(dep_hour > 6 AND dep_hour <= 12 AS INT) AS time_of_day_morning,
  CAST(dep_hour > 12 AND dep_hour <= 18 AS INT) AS time_of_day_afternoon,
  CAST(dep_hour > 18 AND dep_hour <= 24 AS INT) AS time_of_day_evening,
  CAST(month IN (3, 4, 5) AS INT) AS season_spring,
  CAST(month IN (6, 7, 8) AS INT) AS season_summer,
  CAST(month IN (12, 1, 2) AS INT) AS season_winter,
  CAST(distance > 500 AND distance <= 1000 AS INT) AS distance_group_medium,
  CAST(distance > 1000 AND distance <= 2000 AS INT) AS distance_group_long,
  CAST(distance > 2000 AND distance <= 6000 AS INT) AS distance_group_ultra_long
FROM chk
LEFT JOIN codes ON chk.carrier = codes.v
LEFT JOIN osh ON chk.origin = osh.v
LEFT JOIN dsh ON chk.dest = dsh.v
WHERE reasons = ''""", processed=True)


@register("request_features", _request_features_sql())
def request_features(spark, sf):
    """B12 + B13 + fitted serving features for the valid requests."""
    from tarmac.operators.requests import split_valid
    from tarmac.plans.features import serving_features
    valid, _rejected = split_valid(T.score_requests(spark, sf))
    out = serving_features(valid, "fitted", category_model(spark, sf))
    return out.withColumn("log_distance", F.round("log_distance", 9))


def _parity_sql():
    from tarmac.plans.features import FEATURES
    compat = {
        "carrier_encoded": "coalesce(CASE upper(carrier_raw) " + " ".join(
            f"WHEN '{k}' THEN {v}" for k, v in K.SERVING_CARRIER_CODES.items()) + " END, 0)",
        "origin_freq": f"{1 / len(K.AIRPORTS)!r}",
        "dest_freq": f"{1 / len(K.AIRPORTS)!r}",
        "season_winter": "0",
        "distance_group_ultra_long": "CAST(Distance > 2000 AS INT)",
    }
    inner = _request_features_sql().replace(
        "SELECT request_id, month AS Month", "SELECT request_id, carrier AS carrier_raw, month AS Month", 1)
    body = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS DISTINCT FROM {compat.get(c, c)}) "
        f"AS differing_rows FROM rf" for c in FEATURES)
    return f"WITH rf AS ({inner})\n{body}"


@register("feature_parity", _parity_sql())
def feature_parity(spark, sf):
    """Both feature builders on the same valid requests; rows that differ, per feature."""
    from tarmac.operators.requests import split_valid
    from tarmac.plans.features import FEATURES, serving_features
    valid, _rejected = split_valid(T.score_requests(spark, sf))
    both = serving_features(valid, "fitted", category_model(spark, sf), suffix="_fit",
                            keep_request=True)
    both = serving_features(both, "serving_compat", suffix="_cmp")
    counts = both.agg(*[F.count_if(~F.col(c + "_fit").eqNullSafe(F.col(c + "_cmp"))).alias(c)
                        for c in FEATURES])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("differing_rows"))
                               for c in FEATURES]))
    return counts.select(rows.alias("r")).select("r.*")


@register("score_labels", plog_sql("""
SELECT event_id, CASE WHEN prediction = 1 THEN 'DELAYED' ELSE 'ON TIME' END AS prediction_label,
  round(probability, 4) AS delay_probability, prediction AS is_delayed,
  round(greatest(probability, 1 - probability), 4) AS confidence FROM plog"""))
def score_labels(spark, sf):
    from tarmac.operators.requests import decorate
    return decorate(T.prediction_log(spark, sf)).select(
        "event_id", "prediction_label", "delay_probability", "is_delayed", "confidence")


_HASH_SQL = ("CAST(('0x' || substr(md5(concat(flight_key, '42')), 1, 8))::BIGINT % 5 = 0 AS INT)")


@register("hash_split", O.flights_sql(f"""
SELECT {_HASH_SQL} AS is_test, is_delayed, count(*) AS n FROM cf GROUP BY ALL"""))
def hash_split(spark, sf):
    from tarmac.plans.training import hash_split_flag
    df = cleaned(spark, sf)
    return df.groupBy(hash_split_flag("flight_key").alias("is_test"), K.TARGET) \
             .agg(F.count(F.lit(1)).alias("n"))


def scored_sql(body: str) -> str:
    return O.with_ctes(O.SCORED) + body


_PRED = "CAST(score >= 50 AS INT)"


@register("confusion", scored_sql(f"""
SELECT count(*) FILTER (WHERE label = 0 AND {_PRED} = 0) AS tn,
  count(*) FILTER (WHERE label = 0 AND {_PRED} = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND {_PRED} = 0) AS fn,
  count(*) FILTER (WHERE label = 1 AND {_PRED} = 1) AS tp, count(*) AS n FROM scored"""))
def confusion_q(spark, sf):
    from tarmac.operators.metrics import confusion
    return confusion(_thresholded(spark, sf))


def _thresholded(spark, sf):
    s = T.scored(spark, sf)
    return s.withColumn("prediction", (F.col("score") >= 50).cast("int"))


_CONF = f"""
, c AS (SELECT count(*) FILTER (WHERE label = 0 AND {_PRED} = 0) AS tn,
  count(*) FILTER (WHERE label = 0 AND {_PRED} = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND {_PRED} = 0) AS fn,
  count(*) FILTER (WHERE label = 1 AND {_PRED} = 1) AS tp FROM scored)"""


@register("class_metrics", scored_sql(_CONF + """
SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_score FROM c"""))
def class_metrics_q(spark, sf):
    from tarmac.operators.metrics import class_metrics, confusion
    return class_metrics(confusion(_thresholded(spark, sf)), digits=9)


@register("class_report", scored_sql(_CONF + """
, m AS (SELECT *, tn + fp + fn + tp AS n,
  coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
  coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
  coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f0,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT 'On-Time' AS class, round(p0, 9) AS precision, round(r0, 9) AS recall, round(f0, 9) AS f1_score, tn + fp AS support FROM m
UNION ALL SELECT 'Delayed', round(p1, 9), round(r1, 9), round(f1, 9), tp + fn FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / n, 9), n FROM m
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 9), round((r0 + r1) / 2, 9), round((f0 + f1) / 2, 9), n FROM m
UNION ALL SELECT 'weighted avg', round(p0 * (tn + fp) / n + p1 * (tp + fn) / n, 9),
  round(r0 * (tn + fp) / n + r1 * (tp + fn) / n, 9), round(f0 * (tn + fp) / n + f1 * (tp + fn) / n, 9), n FROM m"""))
def class_report_q(spark, sf):
    from tarmac.operators.metrics import class_report, confusion
    r = class_report(confusion(_thresholded(spark, sf)))
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")],
                    "support")


@register("auc", scored_sql("""
, r AS (SELECT label, rank() OVER (ORDER BY score) AS lo,
        count(*) OVER (PARTITION BY score) AS ties FROM scored WHERE score IS NOT NULL)
SELECT round((sum(CASE WHEN label = 1 THEN lo + (ties - 1) / 2.0 ELSE 0 END)
   - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
   / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 9) AS roc_auc,
  count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives
FROM r"""))
def auc(spark, sf):
    from tarmac.operators.metrics import roc_auc
    r = roc_auc(T.scored(spark, sf))
    return r.withColumn("roc_auc", F.round("roc_auc", 9))


# --- step 7: drift ---------------------------------------------------------------

def _ks_sql(ref_src: str, prod_src: str, pairs: list[tuple[str, str]], gate: bool = False) -> str:
    union = "\n  UNION ALL ".join(
        [f"SELECT '{p}' AS feature, CAST({r} AS DOUBLE) AS value, 'ref' AS side FROM {ref_src}"
         for p, r in pairs] +
        [f"SELECT '{p}', CAST({p} AS DOUBLE), 'prod' FROM {prod_src}" for p, r in pairs])
    where_gate = f"AND (SELECT count(*) FROM {prod_src}) >= {K.DRIFT_MIN_ROWS}" if gate else ""
    return f"""
, lf AS (SELECT * FROM ({union}) WHERE value IS NOT NULL)
, mom AS (
  SELECT feature, count(*) FILTER (WHERE side = 'ref') AS n_ref,
    count(*) FILTER (WHERE side = 'prod') AS n_prod,
    avg(value) FILTER (WHERE side = 'ref') AS ref_mean, avg(value) FILTER (WHERE side = 'prod') AS prod_mean,
    stddev_pop(value) FILTER (WHERE side = 'ref') AS ref_std,
    stddev_pop(value) FILTER (WHERE side = 'prod') AS prod_std
  FROM lf GROUP BY feature)
, pv AS (SELECT feature, value, count(*) FILTER (WHERE side = 'ref') AS c_ref,
    count(*) FILTER (WHERE side = 'prod') AS c_prod FROM lf GROUP BY ALL)
, cum AS (SELECT feature, value,
    sum(c_ref) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
    sum(c_prod) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp
  FROM pv)
, dd AS (SELECT cum.feature, max(abs(cr / n_ref - cp / n_prod)) AS d FROM cum JOIN mom USING (feature)
  GROUP BY cum.feature)
, r AS (SELECT dd.feature, d, mom.* EXCLUDE (feature)
  FROM dd JOIN mom ON dd.feature = mom.feature WHERE n_ref > 0 AND n_prod > 0 {where_gate})
, ex AS (SELECT feature, sm, lg, sm // g AS a, lg // g AS b, CAST(round(d * (sm // g) * lg) AS BIGINT) AS edge
  FROM (SELECT feature, d, least(n_ref, n_prod) AS sm, greatest(n_ref, n_prod) AS lg, gcd(n_ref, n_prod) AS g FROM r)
  WHERE lg <= 10000)
, lat AS (
  SELECT feature, sm, lg, a, b, edge, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS lo, [0e0] AS cells FROM ex
  UNION ALL
  SELECT feature, sm, lg, a, b, edge, s + 1, nlo, [(coalesce(cells[i - lo], 1e0) * i
      + coalesce(cells[i - lo + 1], 1e0) * (s + 1 - i)) / (s + 1) for i in range(nlo, nhi + 1)]
  FROM (SELECT *, greatest(0, s + 1 - lg, CAST(floor(CAST((s + 1) * a - edge AS DOUBLE) / (a + b)) AS BIGINT) + 1) AS nlo,
      least(sm, s + 1, CAST(ceil(CAST((s + 1) * a + edge AS DOUBLE) / (a + b)) AS BIGINT) - 1) AS nhi
    FROM lat WHERE s < sm + lg))
, small AS (SELECT feature, CASE WHEN edge <= 0 THEN 1e0 ELSE coalesce(cells[sm - lo + 1], 1e0) END AS p
  FROM lat WHERE s = sm + lg)
, large AS (SELECT feature, en, z, [pi() * pi() * (k + 0.5e0) ** 2 for k in range(0, 100)] AS odd,
    [pi() * pi() * k * k for k in range(1, 100)] AS whole
  FROM (SELECT feature, en, d * sqrt(en) AS z FROM (SELECT feature, d,
      CAST(round(CAST(n_ref AS DOUBLE) * n_prod / (n_ref + n_prod)) AS DOUBLE) AS en FROM r WHERE greatest(n_ref, n_prod) > 10000)))
, sums AS (SELECT feature, en, z,
    list_sum([exp(-x / (2 * z * z)) for x in odd]) AS k0,
    list_sum([(x - z * z) * exp(-x / (2 * z * z)) for x in odd]) AS k1,
    list_sum([(6 * z ** 6 + 2 * z ** 4 + (2 * z ** 4 - 5 * z ** 2) * x + (1 - 2 * z ** 2) * x ** 2)
      * exp(-x / (2 * z * z)) for x in odd]) AS k2,
    list_sum([x * exp(-x / (2 * z * z)) for x in whole]) AS m2,
    list_sum([(-30 * z ** 6 - 90 * z ** 8 + (135 * z ** 4 - 96 * z ** 6) * x + (-60 * z ** 2 + 212 * z ** 4) * x ** 2
      + (5 - 30 * z ** 2) * x ** 3) * exp(-x / (2 * z * z)) for x in odd]) AS k3,
    list_sum([(3 * x * z * z - x * x) * exp(-x / (2 * z * z)) for x in whole]) AS m3
  FROM large)
, pv2 AS (SELECT feature, p FROM small UNION ALL
  SELECT feature, CASE WHEN z * z > 18 THEN 0e0 WHEN z * sqrt(en) <= 0.5 THEN 1e0 ELSE greatest(0e0, least(1e0, 1 - sqrt(2 * pi()) * (
    k0 / z + k1 / (6 * z ** 4 * sqrt(en)) + (k2 / (72 * z ** 7) - m2 / (36 * z ** 3)) / en
    + (k3 / (6480 * z ** 10) + m3 / (216 * z ** 6)) / en ** 1.5))) END FROM sums)
, pr AS (SELECT r.*, p FROM r JOIN pv2 ON r.feature = pv2.feature)
SELECT feature, p < {K.DRIFT_ALPHA} AS drift, round(p, 6) AS p_value, round(d, 6) AS ks_statistic,
  round(ref_mean, 4) AS ref_mean, round(prod_mean, 4) AS prod_mean,
  round(ref_std, 4) AS ref_std, round(prod_std, 4) AS prod_std
FROM pr"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _drift_sql(gate: bool = False) -> str:
    return _recursive(O.with_ctes(O.FLIGHTS_RAW, O.CLEAN, O.PROCESSED, O.PREDICTION_LOG).rstrip()
                      + _ks_sql("pf", "plog", K.DRIFT_FEATURES, gate))


def _drift_inputs(spark, sf):
    # The monitored training columns need no fitted encoder: the cleaned rows
    # (the processed table's rows) carry them directly.
    return cleaned(spark, sf), T.prediction_log(spark, sf)


@register("ks_drift", _drift_sql())
def ks_drift_q(spark, sf):
    """Training table against the prediction log on the four monitored features."""
    from tarmac.operators.drift import ks_drift
    ref, prod = _drift_inputs(spark, sf)
    return ks_drift(ref, prod)


@register("drift_gate", _drift_sql(gate=True))
def drift_gate(spark, sf):
    """The same test behind the minimum-sample gate."""
    from tarmac.operators.drift import gated_drift
    ref, prod = _drift_inputs(spark, sf)
    return gated_drift(ref, prod)


@register("drift_report", _drift_sql().replace(
    "SELECT feature, p < ", ", res AS (SELECT feature, p < ", 1) + """)
SELECT (SELECT count(*) FROM pf) AS n_reference, (SELECT count(*) FROM plog) AS n_production,
  count(*) AS n_features, coalesce(bool_or(drift), false) AS any_drift,
  string_agg(CASE WHEN drift THEN feature END, ',' ORDER BY feature) AS drifted_features
FROM res""")
def drift_report_q(spark, sf):
    """The report's scalar part; the nested JSON form is the A12 sink."""
    from tarmac.operators.drift import drift_report, ks_drift
    ref, prod = _drift_inputs(spark, sf)
    report = drift_report(ks_drift(ref, prod), ref.count(), prod.count(), generated_at=False)
    drifted = F.array_sort(F.map_keys(F.map_filter("features", lambda k, v: v["drift"])))
    return report.select(
        "n_reference", "n_production", F.size("features").cast("long").alias("n_features"), "any_drift",
        F.nullif(F.array_join(drifted, ","), F.lit("")).alias("drifted_features"))


@register("ks_value_split", _recursive(O.with_ctes("""
ev AS (SELECT event_id, value FROM events),
mid AS (SELECT (min(event_id) + max(event_id) + 1) // 2 AS m FROM events)""").rstrip() + _ks_sql(
    "(SELECT value FROM ev, mid WHERE event_id < m)", "(SELECT value FROM ev, mid WHERE event_id >= m)",
    [("value", "value")])))
def ks_value_split(spark, sf):
    """J1 on one column: the earlier half of the event log against the later half."""
    from tarmac.operators.drift import ks_drift
    ref, prod = T.drift_pair(spark, sf)
    return ks_drift(ref, prod, features=[("value", "value")])


# --- step 8/9: models, runs, attributions (no SQL form: checked by invariants) ---

_TRAINED: dict = {}

#: Sizes of the models that the registered queries fit: the original ones.
MODEL_PRESET = os.environ.get("TARMAC_MODEL_PRESET", "reference")


def trained(spark, sf, preset: str = MODEL_PRESET):
    """Train once per (application, input, preset); later queries reuse the artifacts."""
    from tarmac.plans.features import transform
    from tarmac.plans.training import train_all
    from tarmac.session import shared_path
    key = (spark.sparkContext.applicationId, sf, preset)
    if key not in _TRAINED:
        proc, cats = transform(T.flights_raw(spark, sf), keep_key=True)
        root = shared_path(spark, "models", unique=True)
        res = train_all(proc, root, preset, runs_path=f"{root}/runs")
        _TRAINED[key] = (res, root, cats, proc)
    return _TRAINED[key]


@register("train_compare")
def train_compare(spark, sf):
    """H6 + G9 + G10: fit the three models, hold-out metrics, best marked."""
    res, _root, _cats, _proc = trained(spark, sf)
    return res.comparison.drop("train_time_seconds")


@register("best_run")
def best_run_q(spark, sf):
    """Best logged run by F1 (ties: earliest start)."""
    from tarmac.plans.runs import best_run, read_runs
    _res, root, _cats, _proc = trained(spark, sf)
    return best_run(read_runs(spark, f"{root}/runs")).select("run_name", "params", "metrics")


@register("evaluate_model")
def evaluate_model(spark, sf):
    """H7: reload the best model and artifacts, class report on the re-derived hold-out."""
    from tarmac.plans.training import evaluate_job
    _res, root, _cats, proc = trained(spark, sf)
    _metrics, _conf, report = evaluate_job(proc, root, runs_path=f"{root}/runs")
    return report


@register("score_batch")
def score_batch(spark, sf):
    """H8: validate, feature, scale, score and decorate every request row."""
    from tarmac.plans.scoring import score_requests
    from tarmac.plans.training import load_artifacts, load_best
    _res, root, cats, _proc = trained(spark, sf)
    name, model = load_best(spark, root)
    scaler, feats = load_artifacts(spark, root)
    scored, _rejected = score_requests(T.score_requests(spark, sf), model, name, scaler, feats, cats)
    return scored.select("request_id", "prediction_label", "delay_probability", "is_delayed",
                         "confidence", "model_type", "features_used")


def _forest(spark, sf):
    from tarmac.plans.training import load_artifacts, load_model
    res, root, _cats, _proc = trained(spark, sf)
    _scaler, feats = load_artifacts(spark, root)
    return load_model("RandomForest", res.model_paths["RandomForest"]), feats


@register("importances")
def importances_q(spark, sf):
    """Top-10 forest importances, descending."""
    from tarmac.operators.topk import top_values
    from tarmac.plans.scoring import importances
    model, feats = _forest(spark, sf)
    return top_values(importances(spark, model, feats), "feature", "importance", 10)


@register("importance_table")
def importance_table(spark, sf):
    """Ranked importance table with 4-digit text values."""
    from tarmac.operators.topk import ranked_table
    from tarmac.plans.scoring import importances
    model, feats = _forest(spark, sf)
    return ranked_table(importances(spark, model, feats), "feature", "importance")


@register("model_info")
def model_info_q(spark, sf):
    """H9: description of the selected model."""
    from tarmac.plans.scoring import model_info
    from tarmac.plans.training import load_artifacts, load_best
    _res, root, _cats, _proc = trained(spark, sf)
    name, model = load_best(spark, root)
    _scaler, feats = load_artifacts(spark, root)
    return model_info(spark, model, name, feats)


def _assembled_requests(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from tarmac.operators.requests import split_valid
    from tarmac.plans.features import align, serving_features
    from tarmac.plans.training import load_artifacts
    _res, root, cats, _proc = trained(spark, sf)
    scaler, feats = load_artifacts(spark, root)
    valid, _rej = split_valid(T.score_requests(spark, sf))
    f = align(serving_features(valid, "fitted", cats), feats, keep=["request_id"])
    x = VectorAssembler(inputCols=feats, outputCol="features").transform(
        f.select("request_id", *scaler.columns()))
    return x, feats


@register("attributions_linear")
def attributions_linear(spark, sf):
    """H10 (linear): exact contributions; base + sum = margin."""
    from tarmac.operators.attributions import feature_means, linear_attributions
    from tarmac.plans.training import load_model
    res, _root, _cats, _proc = trained(spark, sf)
    model = load_model("LogisticRegression", res.model_paths["LogisticRegression"])
    x, feats = _assembled_requests(spark, sf)
    train = res.prepared.data.filter(F.col("is_test") == 0)
    ref = feature_means(train, len(feats))
    return linear_attributions(x, model, reference_mean=ref).select(
        "request_id", "base", "contributions", "margin")


@register("attributions_tree")
def attributions_tree(spark, sf):
    """H10 (trees): path contributions of the boosted model; base + sum = margin."""
    from tarmac.operators.attributions import tree_attributions
    res, _root, _cats, _proc = trained(spark, sf)
    x, feats = _assembled_requests(spark, sf)
    return tree_attributions(x, res.model_paths["GradientBoosting"], len(feats), "gbt")


@register("top_attributions")
def top_attributions(spark, sf):
    """Per row, the 15 largest |contributions| (sorted inside the row, no shuffle)."""
    from tarmac.operators.topk import top_k_by_abs
    from tarmac.plans.training import load_artifacts
    _res, root, _cats, _proc = trained(spark, sf)
    _scaler, feats = load_artifacts(spark, root)
    a = attributions_tree(spark, sf)
    return a.select("request_id", top_k_by_abs("contributions", feats, 15).alias("top"))


def _background_sql():
    from tarmac.plans.features import FEATURES
    cols = ", ".join("round(log_distance, 9) AS log_distance" if c == "log_distance" else c
                     for c in FEATURES)
    order = ", ".join(FEATURES)
    return O.flights_sql(f"""
SELECT flight_key, {cols} FROM pf
ORDER BY ('0x' || substr(md5(concat(flight_key, '42')), 1, 8))::BIGINT, flight_key, {order}
LIMIT 50""", processed=True)


@register("background_sample", _background_sql())
def background_sample_q(spark, sf):
    """A repeatable 50-row background set of the feature columns."""
    from tarmac.operators.topk import background_sample
    from tarmac.plans.features import FEATURES
    proc = processed(spark, sf)
    out = background_sample(proc.select("flight_key", *FEATURES), "flight_key", 50)
    return out.withColumn("log_distance", F.round("log_distance", 9))


# --- step 10: streams ---------------------------------------------------------------

def _stage_requests(spark, sf):
    """Land the request rows as files in a fresh folder (the stream's source)."""
    from tarmac.session import shared_path
    base = shared_path(spark, "stream", unique=True)
    T.score_requests(spark, sf).write.mode("overwrite").parquet(f"{base}/requests")
    return base


@register("stream_score")
def stream_score(spark, sf):
    """K1: request files -> streaming validate/feature/score -> file sink (availableNow)."""
    from tarmac.streaming.scoring import run_scoring_stream
    _res, root, cats, _proc = trained(spark, sf)
    base = _stage_requests(spark, sf)
    q = run_scoring_stream(spark, f"{base}/requests", f"{base}/scored", f"{base}/ckpt", root, cats)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/scored").select(
        "request_id", "prediction_label", "delay_probability", "is_delayed", "confidence",
        "model_type", "features_used")


@register("stream_log")
def stream_log(spark, sf):
    """K2: micro-batches append accepted rows to the log and rejects to quarantine."""
    from tarmac.streaming.scoring import run_log_stream
    _res, root, cats, _proc = trained(spark, sf)
    base = _stage_requests(spark, sf)
    q = run_log_stream(spark, f"{base}/requests", f"{base}/log", f"{base}/quarantine",
                       f"{base}/ckpt", root, cats)
    q.awaitTermination()
    from tarmac.sources.files import read_log
    from tarmac.sources.parts import read_parts
    log = read_log(spark, f"{base}/log")
    bad = read_parts(spark, f"{base}/quarantine")
    return A.log_kpis(log).select(
        "total_predictions", "delayed_rate", "avg_probability",
        F.lit(bad.count()).cast("long").alias("quarantined"))


@register("log_written", plog_sql("""
SELECT * EXCLUDE (event_id) FROM plog ORDER BY event_id DESC LIMIT 20"""))
def log_written(spark, sf):
    """The log appended in two parts, read back, its last 20 rows."""
    from tarmac.operators.topk import recent
    from tarmac.session import shared_path
    from tarmac.sources.files import append_log, read_log
    path = shared_path(spark, "log", unique=True)
    log = T.prediction_log(spark, sf)
    middle = log.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (log.filter(F.col("event_id") <= middle), log.filter(F.col("event_id") > middle)):
        append_log(part.repartitionByRange("event_id").sortWithinPartitions("event_id"), path)
    return recent(read_log(spark, path), 20).drop("event_id")


@register("training_scan", O.flights_sql("""
SELECT is_delayed, count(*) AS n FROM pf GROUP BY is_delayed""", processed=True))
def training_scan(spark, sf):
    """The SQL table that training reads, one column of it."""
    from tarmac.sources.files import load_table, training_data
    load_table(processed(spark, sf, keep_key=False), "flights_training")
    return training_data(spark, "flights_training").groupBy(K.TARGET).agg(F.count(F.lit(1)).alias("n"))


# --- sources, sinks and SQL tables (A4-A9, P1, G3) --------------------------------

@register("preview", plog_sql("""
SELECT * FROM plog ORDER BY event_id LIMIT 5"""))
def preview_q(spark, sf):
    """The first rows after a stable order."""
    from tarmac.operators.topk import preview
    return preview(T.prediction_log(spark, sf), ["event_id"], 5)


@register("etl_roundtrip", O.flights_sql("""
SELECT Reporting_Airline, count(*) AS flights, round(avg(is_delayed), 9) AS delay_rate,
  round(sum(log_distance), 6) AS sum_log_distance, CAST(sum(carrier_encoded) AS BIGINT) AS sum_codes,
  round(sum(origin_freq), 9) AS sum_origin_freq
FROM pf GROUP BY Reporting_Airline""", processed=True))
def etl_roundtrip(spark, sf):
    """P1 + A4 + A9: run the ETL job to Parquet, re-read it column-pruned, aggregate."""
    from tarmac.plans.etl import run_etl
    from tarmac.session import shared_path
    out = shared_path(spark, "etl", unique=True)
    run_etl(spark, f"{out}/processed", raw=T.flights_raw(spark, sf))
    from tarmac.sources.files import read_processed
    df = read_processed(spark, f"{out}/processed",
                        ["Reporting_Airline", K.TARGET, "log_distance", "carrier_encoded",
                         "origin_freq"])
    return df.groupBy("Reporting_Airline").agg(
        F.count(F.lit(1)).alias("flights"), F.round(F.avg(K.TARGET), 9).alias("delay_rate"),
        F.round(F.sum("log_distance"), 6).alias("sum_log_distance"),
        F.sum("carrier_encoded").alias("sum_codes"),
        F.round(F.sum("origin_freq"), 9).alias("sum_origin_freq"))


@register("sql_table_stats", O.flights_sql("""
SELECT count(*) AS total_flights, round(avg(is_delayed), 9) AS delay_rate,
  round(avg(CASE WHEN is_delayed = 1 THEN ArrDelay END), 9) AS avg_delay,
  count(DISTINCT Reporting_Airline) AS carriers, count(DISTINCT Origin) AS airports
FROM pf""", processed=True))
def sql_table_stats(spark, sf):
    """A5 + A7 + F2: load the processed table as a SQL table, then the summary in SQL."""
    from tarmac.session import shared_path
    from tarmac.sources.files import load_table, query
    name = "flights_" + T.short_id(sf)
    load_table(processed(spark, sf), name, path=shared_path(spark, "tables", name, unique=True))
    return query(spark, f"""
        SELECT count(*) AS total_flights, round(avg(is_delayed), 9) AS delay_rate,
          round(avg(CASE WHEN is_delayed = 1 THEN ArrDelay END), 9) AS avg_delay,
          count(DISTINCT Reporting_Airline) AS carriers, count(DISTINCT Origin) AS airports
        FROM {name}""")


def _declared_sql():
    from tarmac.sources.files import DECLARED_SCHEMA
    sel = ", ".join("round(log_distance, 9) AS log_distance" if c == "log_distance" else c
                    for c in DECLARED_SCHEMA.fieldNames())
    return O.flights_sql(f"SELECT {sel} FROM pf", processed=True)


@register("declared_flights", _declared_sql())
def declared_flights(spark, sf):
    """The processed rows conformed to the declared 23-column table schema."""
    from tarmac.sources.files import DECLARED_SCHEMA, conform
    out = conform(processed(spark, sf, keep_key=False), DECLARED_SCHEMA)
    return out.withColumn("log_distance", F.round("log_distance", 9))


_STRAT_HASH = "('0x' || substr(md5(concat(flight_key, '42')), 1, 8))::BIGINT"


@register("stratified_split", O.flights_sql(f"""
, h AS (SELECT is_delayed, {_STRAT_HASH} AS hh FROM cf)
, per AS (SELECT is_delayed, hh, count(*) AS n FROM h GROUP BY ALL)
, cum AS (SELECT is_delayed, hh,
    coalesce(sum(n) OVER (PARTITION BY is_delayed ORDER BY hh
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(n) OVER (PARTITION BY is_delayed) AS tot FROM per)
, cut AS (SELECT is_delayed, min(hh) AS c FROM cum WHERE before >= (tot + 4) // 5 GROUP BY is_delayed)
SELECT CAST(h.hh < cut.c AS INT) AS is_test, h.is_delayed, count(*) AS n
FROM h JOIN cut ON h.is_delayed = cut.is_delayed GROUP BY ALL"""))
def stratified_split(spark, sf):
    """H1 exact-count mode: per class ceil(20 %) hold-out rows by hash order."""
    from tarmac.plans.training import stratified_split_flag
    df = cleaned(spark, sf)
    return df.groupBy(stratified_split_flag(df).alias("is_test"), K.TARGET) \
             .agg(F.count(F.lit(1)).alias("n"))
