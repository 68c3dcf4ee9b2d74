"""Adapters from the driver's star-schema tables to this engine's inputs.

The test tables hold no flights, so flights and prediction-log rows are
*derived* from them by fixed arithmetic rules (documented in FIXTURES.md §8).
All work is lazy DataFrame code: the fact table (lineitem) is joined to orders
by a shuffle join and to the small dimensions by size-checked broadcasts.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import columns as X
from tarmac.functions import constants as K
from tarmac.operators.joins import lookup_join

def per_session(fn):
    """Memoize a lazy DataFrame builder per (application, arguments).

    A DataFrame is an immutable logical plan: handing the same plan object to
    several queries re-plans nothing and lists no files twice.  No data is
    cached by this.
    """
    memo: dict = {}

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, *args, **kwargs):
        key = (spark.sparkContext.applicationId, args, tuple(sorted(kwargs.items())))
        if key not in memo:
            memo[key] = fn(spark, *args, **kwargs)
        return memo[key]
    return wrapper


@per_session
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Input tables are immutable within a run: their row counts (the size check
# before a broadcast) are taken once per path.
_ROWS: dict[str, int] = {}


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    path = os.path.join(sf_dir, f"{name}.parquet")
    if path not in _ROWS:
        _ROWS[path] = spark.read.parquet(path).count()
    return _ROWS[path]


def short_id(sf_dir: str) -> str:
    """A stable identifier-safe tag for an input folder (for table names)."""
    import hashlib
    return hashlib.md5(sf_dir.encode()).hexdigest()[:10]


def carrier_from_key(key) -> F.Column:
    col = F.col(key) if isinstance(key, str) else key
    # Adapter rule: the carriers in their listed order, picked by key % 10.
    codes = F.array(*[F.lit(c) for c in K.CARRIER_NAMES])
    return F.element_at(codes, (col % 10 + 1).cast("int"))


def _nation_names(spark, sf_dir, key_name, name_name):
    return (table(spark, sf_dir, "nation")
            .select(F.col("n_nationkey").alias(key_name), F.col("n_name").alias(name_name)))


@per_session
def flights_raw(spark: SparkSession, sf_dir: str, with_key: bool = True) -> DataFrame:
    """28-column raw flight table (plus ``flight_key``) derived from lineitem."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Dimensions: nation names folded into supplier and customer first, so
    # only one narrow column per side crosses the large joins.
    n_nation = table_rows(spark, sf_dir, "nation")
    supp = lookup_join(
        table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk")),
        _nation_names(spark, sf_dir, "nk", "Origin"), "nk", "inner", dim_rows=n_nation).drop("nk")
    cust = lookup_join(
        table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk")),
        _nation_names(spark, sf_dir, "nk", "Dest"), "nk", "inner", dim_rows=n_nation).drop("nk")

    # Customer -> orders first (orders are ~1/4 of the fact rows), then the
    # large join fact x orders on the order key.  The customer and
    # supplier sides are broadcast only if their checked row counts are under
    # the bound (the inner nation join keeps their row counts).
    orders = lookup_join(orders, cust, orders.o_custkey == cust.c_custkey, "inner",
                         dim_rows=table_rows(spark, sf_dir, "customer"))
    # The fact side is always the streamed side: orders is broadcast only under
    # the checked row bound, otherwise this is a shuffle join on the order key.
    fact = lookup_join(li, orders, li.l_orderkey == orders.o_orderkey, "inner",
                       dim_rows=table_rows(spark, sf_dir, "orders"))
    fact = lookup_join(fact, supp, fact.l_suppkey == supp.s_suppkey, "inner",
                       dim_rows=table_rows(spark, sf_dir, "supplier"))

    d = F.col("o_orderdate")
    dep_delay = F.when(F.col("l_discount") > 0.075, F.lit(15.0) + F.col("l_quantity")) \
        .otherwise(F.floor(F.col("l_quantity") / 5).cast("double") - 7)
    distance = (F.when(F.col("l_partkey") % 97 == 0, F.lit(0))
                .when(F.col("l_partkey") % 101 == 0, F.lit(6500))
                .otherwise(F.lit(200) + F.floor(F.col("l_extendedprice")) % 4800)).cast("int")
    taxi_out = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("int")) \
        .otherwise(F.lit(3) + F.col("l_quantity").cast("int") % 40).cast("int")

    base = fact.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("flight_key"),
        F.year(d).cast("int").alias("Year"),
        F.quarter(d).cast("int").alias("Quarter"),
        F.month(d).cast("int").alias("Month"),
        F.dayofmonth(d).cast("int").alias("DayofMonth"),
        X.iso_day_of_week(d).alias("DayOfWeek"),
        F.to_date(d).alias("FlightDate"),
        carrier_from_key("l_suppkey").alias("Reporting_Airline"),
        (F.lit(100) + F.col("l_partkey") % 9899).cast("int").alias("Flight_Number_Reporting_Airline"),
        "Origin", "Dest",
        ((F.col("l_orderkey") % 24) * 100 + (F.col("l_linenumber") * 5) % 60).cast("int").alias("CRSDepTime"),
        dep_delay.alias("DepDelay"),
        taxi_out.alias("TaxiOut"),
        (F.lit(2) + F.col("l_linenumber")).cast("int").alias("TaxiIn"),
        (F.col("l_partkey") % 50 == 0).cast("int").alias("Cancelled"),
        (F.col("l_orderkey") % 333 == 0).cast("int").alias("Diverted"),
        distance.alias("Distance"),
        (F.col("l_partkey") % 33 - 16).cast("double").alias("_arr_noise"),
        (F.col("l_partkey") % 11).cast("int").alias("_crs_noise"),
    )
    air_time = F.greatest(F.lit(20), F.floor(F.col("Distance") / 8)).cast("int")
    # Derived columns in three projections (one analysis each, not one per column).
    step1 = base.withColumns({
        "ArrDelay": F.col("DepDelay") + F.col("_arr_noise"),
        "AirTime": air_time,
    })
    step2 = step1.withColumns({
        "ActualElapsedTime": X.elapsed_total("TaxiOut", "AirTime", "TaxiIn").cast("int"),
        "DepDelayMinutes": X.clamp_non_negative("DepDelay"),
        "ArrDelayMinutes": X.clamp_non_negative("ArrDelay"),
        "_causes": X.cause_allocation("ArrDelay"),
    })
    derived = {"CRSElapsedTime": (F.col("ActualElapsedTime") - F.col("_crs_noise") + 5).cast("int")}
    derived.update({name: F.col("_causes")[i] for i, name in enumerate(K.CAUSE_COLUMNS)})
    out = step2.withColumns(derived)
    cols = (["flight_key"] if with_key else []) + K.RAW_COLUMNS
    return out.select(*cols)


@per_session
def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-log rows derived from ``events`` (event_id is the append order)."""
    ev = table(spark, sf_dir, "events")
    ev = ev.withColumns({"_ok": (F.col("user_id") % 25).cast("int"),
                         "_dk": ((F.col("user_id") + F.col("event_id")) % 25).cast("int")})
    n_nation = table_rows(spark, sf_dir, "nation")
    ev = lookup_join(ev, _nation_names(spark, sf_dir, "_ok", "origin"), "_ok", "left", dim_rows=n_nation)
    ev = lookup_join(ev, _nation_names(spark, sf_dir, "_dk", "dest"), "_dk", "left", dim_rows=n_nation)
    return ev.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        carrier_from_key("user_id").alias("carrier"),
        "origin", "dest",
        (F.lit(1) + F.col("user_id") % 12).cast("int").alias("month"),
        F.hour("ts").cast("int").alias("dep_hour"),
        (F.lit(50) + (F.col("event_id") * 37) % 5951).cast("int").alias("distance"),
        F.round(F.col("value") - 50, 2).cast("double").alias("dep_delay"),
        (F.col("event_type") == "error").cast("int").alias("prediction"),
        F.least(F.lit(1e0), F.round(F.col("value") / 500, 4)).alias("probability"),
    )


@per_session
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score) pairs for the metric operators; scores tie on purpose."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id",
                     (F.col("event_type") == "error").cast("int").alias("label"),
                     F.round("value", 1).alias("score"))


def drift_pair(spark: SparkSession, sf_dir: str, split_id: int | None = None):
    """Earlier half of the event log (reference) against the later half (production).

    The cut is the midpoint of the append-order range, read from the data
    (one aggregate row), unless given.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    if split_id is None:
        b = ev.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
        split_id = (int(b["lo"]) + int(b["hi"]) + 1) // 2 if b["lo"] is not None else 0
    return (ev.filter(F.col("event_id") < split_id).select("value"),
            ev.filter(F.col("event_id") >= split_id).select("value"))


@per_session
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests built from every flight row (cancelled ones included).

    Distances 0 and 6500 fall outside the accepted range, null taxi-out times
    take the default: both validation paths are exercised.
    """
    raw = flights_raw(spark, sf_dir)
    return raw.select(
        F.col("flight_key").alias("request_id"),
        F.col("Month").alias("month"), F.col("DayofMonth").alias("day_of_month"),
        F.col("DayOfWeek").alias("day_of_week"),
        X.hhmm_hour("CRSDepTime").alias("dep_hour"), X.hhmm_minute("CRSDepTime").alias("dep_minute"),
        F.col("Reporting_Airline").alias("carrier"), F.col("Origin").alias("origin"),
        F.col("Dest").alias("dest"), F.col("Distance").alias("distance"),
        F.col("DepDelay").alias("dep_delay"), F.col("TaxiOut").alias("taxi_out"),
        F.col("CRSElapsedTime").alias("crs_elapsed_time"))
