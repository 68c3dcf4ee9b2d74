"""Independent DuckDB SQL twins of the registered queries.

Each string runs on the driver's pre-registered views (lineitem, orders, ...).
They re-derive the flight and prediction-log adapters in SQL, so the Spark
code and the SQL only share the written-down rules, not code.
"""

from __future__ import annotations

from tarmac.functions import constants as K

CARRIER_LIST = "[" + ", ".join(f"'{c}'" for c in K.CARRIER_NAMES) + "]"

_NUMERIC_RAW = ["Year", "Quarter", "Month", "DayofMonth", "DayOfWeek",
                "Flight_Number_Reporting_Airline", "CRSDepTime", "DepDelay",
                "DepDelayMinutes", "TaxiOut", "TaxiIn", "ArrDelay", "ArrDelayMinutes",
                "Cancelled", "Diverted", "CRSElapsedTime", "ActualElapsedTime", "AirTime",
                "Distance"] + K.CAUSE_COLUMNS

FLIGHTS_RAW = f"""
fr0 AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flight_key,
    CAST(year(o_orderdate) AS INT) AS Year,
    CAST(quarter(o_orderdate) AS INT) AS Quarter,
    CAST(month(o_orderdate) AS INT) AS Month,
    CAST(day(o_orderdate) AS INT) AS DayofMonth,
    CAST(isodow(o_orderdate) AS INT) AS DayOfWeek,
    CAST(o_orderdate AS DATE) AS FlightDate,
    list_extract({CARRIER_LIST}, CAST(l_suppkey % 10 + 1 AS INT)) AS Reporting_Airline,
    CAST(100 + l_partkey % 9899 AS INT) AS Flight_Number_Reporting_Airline,
    ns.n_name AS Origin,
    nc.n_name AS Dest,
    CAST((l_orderkey % 24) * 100 + (l_linenumber * 5) % 60 AS INT) AS CRSDepTime,
    CAST(CASE WHEN l_discount > 0.075 THEN 15e0 + l_quantity
              ELSE floor(l_quantity / 5) - 7 END AS DOUBLE) AS DepDelay,
    CAST(CASE WHEN l_linenumber = 7 THEN NULL
              ELSE 3 + CAST(l_quantity AS INT) % 40 END AS INT) AS TaxiOut,
    CAST(2 + l_linenumber AS INT) AS TaxiIn,
    CAST(l_partkey % 50 = 0 AS INT) AS Cancelled,
    CAST(l_orderkey % 333 = 0 AS INT) AS Diverted,
    CAST(CASE WHEN l_partkey % 97 = 0 THEN 0
              WHEN l_partkey % 101 = 0 THEN 6500
              ELSE 200 + CAST(floor(l_extendedprice) AS BIGINT) % 4800 END AS INT) AS Distance,
    CAST(l_partkey % 33 - 16 AS DOUBLE) AS arr_noise,
    CAST(l_partkey % 11 AS INT) AS crs_noise
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey
  JOIN nation ns ON s_nationkey = ns.n_nationkey
),
fr1 AS (
  SELECT *, DepDelay + arr_noise AS ArrDelay,
         CAST(greatest(20, floor(Distance / 8)) AS INT) AS AirTime
  FROM fr0
),
fr2 AS (
  SELECT *, CAST(TaxiOut + AirTime + TaxiIn AS INT) AS ActualElapsedTime FROM fr1
),
flights_raw AS (
  SELECT flight_key, Year, Quarter, Month, DayofMonth, DayOfWeek, FlightDate,
    Reporting_Airline, Flight_Number_Reporting_Airline, Origin, Dest, CRSDepTime,
    DepDelay, greatest(DepDelay, 0) AS DepDelayMinutes, TaxiOut, TaxiIn,
    ArrDelay, greatest(ArrDelay, 0) AS ArrDelayMinutes, Cancelled, Diverted,
    CAST(ActualElapsedTime - crs_noise + 5 AS INT) AS CRSElapsedTime,
    ActualElapsedTime, AirTime, Distance,
    CAST(CASE WHEN ArrDelay > 15 THEN round_even(ArrDelay * 0.3e0, 0) ELSE 0 END AS INT) AS CarrierDelay,
    CAST(CASE WHEN ArrDelay > 15 THEN round_even(ArrDelay * 0.2e0, 0) ELSE 0 END AS INT) AS WeatherDelay,
    CAST(CASE WHEN ArrDelay > 15 THEN round_even(ArrDelay * 0.2e0, 0) ELSE 0 END AS INT) AS NASDelay,
    CAST(CASE WHEN ArrDelay > 15 THEN round_even(ArrDelay * 0.05e0, 0) ELSE 0 END AS INT) AS SecurityDelay,
    CAST(CASE WHEN ArrDelay > 15 THEN round_even(ArrDelay * 0.25e0, 0) ELSE 0 END AS INT) AS LateAircraftDelay
  FROM fr2
)"""

# B1 -> B3 -> B4
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _NUMERIC_RAW)
CLEAN = f"""
clean AS (
  SELECT flight_key, FlightDate, Reporting_Airline, Origin, Dest, {_FILLED}
  FROM flights_raw WHERE Cancelled = 0 AND Diverted = 0
),
cf AS (
  SELECT *, CAST(ArrDelay > 15 AS INT) AS is_delayed,
         CAST(floor(CRSDepTime / 100) AS INT) AS dep_hour,
         CAST(CRSDepTime - 100 * floor(CRSDepTime / 100) AS INT) AS dep_minute
  FROM clean
)"""

_TOD = """CASE WHEN dep_hour > -1 AND dep_hour <= 6 THEN 'night'
  WHEN dep_hour > 6 AND dep_hour <= 12 THEN 'morning'
  WHEN dep_hour > 12 AND dep_hour <= 18 THEN 'afternoon'
  WHEN dep_hour > 18 AND dep_hour <= 24 THEN 'evening' END"""
_DG = """CASE WHEN Distance > 0 AND Distance <= 500 THEN 'short'
  WHEN Distance > 500 AND Distance <= 1000 THEN 'medium'
  WHEN Distance > 1000 AND Distance <= 2000 THEN 'long'
  WHEN Distance > 2000 AND Distance <= 6000 THEN 'ultra_long' END"""
_SEASON = """CASE WHEN Month IN (12, 1, 2) THEN 'winter' WHEN Month IN (3, 4, 5) THEN 'spring'
  WHEN Month IN (6, 7, 8) THEN 'summer' WHEN Month IN (9, 10, 11) THEN 'fall' END"""

# Fitted codes and shares, then the full processed projection.
PROCESSED = f"""
codes AS (
  SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS carrier_encoded
  FROM (SELECT DISTINCT Reporting_Airline AS v FROM cf WHERE Reporting_Airline IS NOT NULL)
),
osh AS (
  SELECT Origin AS v, count(*) / sum(count(*)) OVER () AS origin_freq
  FROM cf WHERE Origin IS NOT NULL GROUP BY Origin
),
dsh AS (
  SELECT Dest AS v, count(*) / sum(count(*)) OVER () AS dest_freq
  FROM cf WHERE Dest IS NOT NULL GROUP BY Dest
),
bins AS (
  SELECT cf.*, {_TOD} AS time_of_day, {_SEASON} AS season, {_DG} AS distance_group,
    coalesce(codes.carrier_encoded, 0) AS carrier_encoded,
    coalesce(osh.origin_freq, 0) AS origin_freq, coalesce(dsh.dest_freq, 0) AS dest_freq
  FROM cf
  LEFT JOIN codes ON cf.Reporting_Airline = codes.v
  LEFT JOIN osh ON cf.Origin = osh.v
  LEFT JOIN dsh ON cf.Dest = dsh.v
),
pf AS (
  SELECT flight_key, Year, FlightDate, Reporting_Airline, Origin, Dest,
    CAST(ArrDelay AS DOUBLE) AS ArrDelay, Flight_Number_Reporting_Airline,
    Month, DayofMonth, DayOfWeek, dep_hour, dep_minute, carrier_encoded,
    CAST(origin_freq AS DOUBLE) AS origin_freq, CAST(dest_freq AS DOUBLE) AS dest_freq,
    Distance, ln(1 + Distance) AS log_distance,
    CAST(DayOfWeek >= 6 AS INT) AS is_weekend, CAST(DepDelay > 0 AS INT) AS dep_delay_flag,
    CAST(DepDelay AS DOUBLE) AS DepDelay, TaxiOut, CRSElapsedTime,
    CAST(coalesce(time_of_day = 'morning', false) AS INT) AS time_of_day_morning,
    CAST(coalesce(time_of_day = 'afternoon', false) AS INT) AS time_of_day_afternoon,
    CAST(coalesce(time_of_day = 'evening', false) AS INT) AS time_of_day_evening,
    CAST(coalesce(season = 'spring', false) AS INT) AS season_spring,
    CAST(coalesce(season = 'summer', false) AS INT) AS season_summer,
    CAST(coalesce(season = 'winter', false) AS INT) AS season_winter,
    CAST(coalesce(distance_group = 'medium', false) AS INT) AS distance_group_medium,
    CAST(coalesce(distance_group = 'long', false) AS INT) AS distance_group_long,
    CAST(coalesce(distance_group = 'ultra_long', false) AS INT) AS distance_group_ultra_long,
    is_delayed, time_of_day, season, distance_group
  FROM bins
)"""

PREDICTION_LOG = f"""
plog AS (
  SELECT event_id, ts AS timestamp,
    list_extract({CARRIER_LIST}, CAST(user_id % 10 + 1 AS INT)) AS carrier,
    no.n_name AS origin, nd.n_name AS dest,
    CAST(1 + user_id % 12 AS INT) AS month,
    CAST(hour(ts) AS INT) AS dep_hour,
    CAST(50 + (event_id * 37) % 5951 AS INT) AS distance,
    CAST(round(value - 50, 2) AS DOUBLE) AS dep_delay,
    CAST(event_type = 'error' AS INT) AS prediction,
    least(1e0, round(value / 500, 4)) AS probability
  FROM events
  LEFT JOIN nation no ON CAST(user_id % 25 AS INT) = no.n_nationkey
  LEFT JOIN nation nd ON CAST((user_id + event_id) % 25 AS INT) = nd.n_nationkey
)"""

SCORED = """
scored AS (
  SELECT event_id, CAST(event_type = 'error' AS INT) AS label, round(value, 1) AS score
  FROM events
)"""


REQUESTS = """
req AS (
  SELECT flight_key AS request_id, Month AS month, DayofMonth AS day_of_month,
    DayOfWeek AS day_of_week, CAST(floor(CRSDepTime / 100) AS INT) AS dep_hour,
    CAST(CRSDepTime - 100 * floor(CRSDepTime / 100) AS INT) AS dep_minute,
    Reporting_Airline AS carrier, Origin AS origin, Dest AS dest, Distance AS distance,
    DepDelay AS dep_delay, TaxiOut AS taxi_out, CRSElapsedTime AS crs_elapsed_time
  FROM flights_raw
),
chk AS (
  SELECT *, concat_ws(',',
    CASE WHEN month IS NULL THEN 'month:missing' END,
    CASE WHEN day_of_month IS NULL THEN 'day_of_month:missing' END,
    CASE WHEN day_of_week IS NULL THEN 'day_of_week:missing' END,
    CASE WHEN dep_hour IS NULL THEN 'dep_hour:missing' END,
    CASE WHEN carrier IS NULL THEN 'carrier:missing' END,
    CASE WHEN origin IS NULL THEN 'origin:missing' END,
    CASE WHEN dest IS NULL THEN 'dest:missing' END,
    CASE WHEN distance IS NULL THEN 'distance:missing' END,
    CASE WHEN month < 1 OR month > 12 THEN 'month:range' END,
    CASE WHEN day_of_month < 1 OR day_of_month > 31 THEN 'day_of_month:range' END,
    CASE WHEN day_of_week < 1 OR day_of_week > 7 THEN 'day_of_week:range' END,
    CASE WHEN dep_hour < 0 OR dep_hour > 23 THEN 'dep_hour:range' END,
    CASE WHEN dep_minute < 0 OR dep_minute > 59 THEN 'dep_minute:range' END,
    CASE WHEN distance < 50 OR distance > 6000 THEN 'distance:range' END,
    CASE WHEN taxi_out < 0 THEN 'taxi_out:range' END) AS reasons
  FROM req
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


def flights_sql(body: str, processed: bool = False) -> str:
    parts = [FLIGHTS_RAW, CLEAN] + ([PROCESSED] if processed else [])
    return with_ctes(*parts) + body
