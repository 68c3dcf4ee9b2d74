"""Aggregations over the flight table and the prediction log.

Every summary is one ``agg`` pass (several statistics fused into a single
scan), and every grouped rate is a ``groupBy`` with map-side partial
aggregation, so a hot key costs one partial row per task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import columns as X
from tarmac.functions import constants as K

DIGITS = 9  # doubles summed in another order differ in the last bits


def _r(c, digits: int = DIGITS):
    return F.round(c, digits)


def delay_rate(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """overall delay rate."""
    return df.agg(_r(F.avg(target)).alias("delay_rate"))


def delay_rate_by(df: DataFrame, key: str, target: str = K.TARGET) -> DataFrame:
    """Delay rate (and flight count) per key, highest rate first."""
    return (df.groupBy(key)
              .agg(_r(F.avg(F.col(target).cast("double"))).alias("delay_rate"),
                   F.count(F.lit(1)).alias("flights"))
              .orderBy(F.col("delay_rate").desc(), F.col(key)))


def delay_rate_by_month(df: DataFrame, month: str = "Month", target: str = K.TARGET) -> DataFrame:
    """F5 + C8: month number, its name (keyed by number), rate."""
    return (delay_rate_by(df, month, target)
            .withColumn("month_name", X.month_name(month))
            .orderBy(month))


def table_summary(df: DataFrame) -> DataFrame:
    """count, delay rate, mean ArrDelay of delayed rows only, distinct carriers/origins."""
    return df.agg(
        F.count(F.lit(1)).alias("total_flights"),
        _r(F.avg(K.TARGET)).alias("delay_rate"),
        _r(F.avg(F.when(F.col(K.TARGET) == 1, F.col("ArrDelay")))).alias("avg_delay"),
        F.countDistinct("Reporting_Airline").alias("carriers"),
        F.countDistinct("Origin").alias("airports"),
    )


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """F8: rows, delay rate, mean DepDelay, distinct carriers - one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_flights"),
        _r(F.avg(K.TARGET)).alias("delay_rate"),
        _r(F.avg("DepDelay")).alias("avg_dep_delay"),
        F.countDistinct("Reporting_Airline").alias("carriers"),
    )


def value_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """normalised value counts of several columns in one scan (long form).

    Shares are over non-null rows of each column.
    """
    from tarmac.operators.encoders import category_counts, shares
    counts = category_counts(df, {c: c for c in columns})
    return shares(counts).select(F.col("kind").alias("column"), "value", "n", "share")


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """exact (or HyperLogLog) distinct counts, all columns in one pass."""
    fn = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(*[fn(c).alias(f"distinct_{c}") for c in columns])


def dataset_summary(df: DataFrame, date: str = "FlightDate") -> DataFrame:
    """Rows, columns, delay rate (ArrDelay > 15), distinct carriers/origins/dests, date range."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        _r(F.avg(X.delay_target("ArrDelay").cast("double"))).alias("delay_rate"),
        F.countDistinct("Reporting_Airline").alias("carriers"),
        F.countDistinct("Origin").alias("origins"),
        F.countDistinct("Dest").alias("dests"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def extract_profile(df: DataFrame, date: str = "FlightDate") -> DataFrame:
    """A3: rows, columns, min/max date, distinct carriers."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.countDistinct("Reporting_Airline").alias("carriers"),
    )


# --- prediction log (F9, F10) ------------------------------------------------

def log_kpis(log: DataFrame) -> DataFrame:
    """count, predicted-delayed rate, mean probability."""
    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        _r(F.avg("prediction")).alias("delayed_rate"),
        _r(F.avg("probability")).alias("avg_probability"),
    )


def prediction_stats(log: DataFrame) -> DataFrame:
    """F9 plus first/last time; an empty log gives total 0 and nulls."""
    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        _r(F.avg("prediction")).alias("delayed_rate"),
        _r(F.avg("probability")).alias("avg_probability"),
        F.min("timestamp").alias("first_prediction"),
        F.max("timestamp").alias("last_prediction"),
    )


def predictions_by_carrier(log: DataFrame) -> DataFrame:
    """counts by carrier, most frequent first."""
    return (log.groupBy("carrier").agg(F.count(F.lit(1)).alias("predictions"))
               .orderBy(F.col("predictions").desc(), "carrier"))


# --- equal-width histograms (F6, F7) ----------------------------------------

def histogram(df: DataFrame, value: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max]; the max falls in the last bin.

    Two passes: one ``agg`` for the bounds (a single row), then a grouped count.
    """
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        # Nothing to bin: the same columns and types, no rows.
        lo = hi = 0.0
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.when(F.lit(hi > lo), F.least(F.lit(bins - 1),
                                       F.floor((F.col(value) - F.lit(lo)) * bins / F.lit(hi - lo if hi > lo else 1.0)))) \
         .otherwise(F.lit(0)).cast("int")
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    return (df.filter(F.col(value).isNotNull())
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bin_start", _r(F.lit(lo) + F.col("bin") * F.lit(width)))
              .withColumn("bin_end", _r(F.lit(lo) + (F.col("bin") + 1) * F.lit(width))))
