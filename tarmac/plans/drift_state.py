"""Drift against a reference that is kept as counts.

The training table is counted once, by (feature, value).  Each committed part of the prediction
log is counted once too; counts of parts add up, so a drift report reads the kept counts and the
parts that came since, never the training table or the whole log.

    <state>/reference   (feature, value, n)
    <state>/production  committed parts of (log_run, log_batch, feature, value, n)

A part without any value still leaves a row (null feature), so it is known to be counted.  An
update that dies leaves nothing behind; updates must not run side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as _parse

from tarmac.functions import constants as K
from tarmac.operators.drift import ks_from_counts, value_counts
from tarmac.sources.files import LOG_SCHEMA
from tarmac.sources.parts import append_part, commits, read_parts

COUNTS = "log_run string, log_batch long, feature string, value double, n long"


def keep_reference(reference: DataFrame, path: str, features: list[tuple[str, str]] = K.DRIFT_FEATURES) -> None:
    """Count the training table into the state (again after every training)."""
    value_counts(reference, dict(features)).write.mode("overwrite").parquet(f"{path}/reference")


def kept_production(spark: SparkSession, path: str) -> DataFrame:
    return read_parts(spark, f"{path}/production", _parse(COUNTS))


def count_new_parts(spark: SparkSession, path: str, log_path: str, features: list[tuple[str, str]] = K.DRIFT_FEATURES) -> int:
    """Count the committed log parts that the state lacks; how many there were."""
    counted = kept_production(spark, path).select(F.col("log_run").alias("run"), F.col("log_batch").alias("batch")).distinct()
    new = commits(spark, log_path).select("run", "batch").join(counted, ["run", "batch"], "left_anti")
    fresh = new.collect()  # one row a part that came since the last update
    if not fresh:
        return 0
    new = spark.createDataFrame(fresh, "run string, batch long")
    rows = read_parts(spark, log_path, LOG_SCHEMA, only=new)
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("feature"), F.col(p).cast("double").alias("value")) for p, _ in features]))
    by_value = (rows.select("run", "batch", pairs.alias("p")).filter("p.value IS NOT NULL")
                .groupBy("run", "batch", "p.feature", "p.value").agg(F.count(F.lit(1)).alias("n")))
    marks = new.select("run", "batch", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value"),
                       F.lit(0).cast("long").alias("n"))
    counts = by_value.unionByName(marks).withColumnsRenamed({"run": "log_run", "batch": "log_batch"})
    append_part(counts, f"{path}/production")
    return len(fresh)


def drift_of_state(spark: SparkSession, path: str, alpha: float = K.DRIFT_ALPHA) -> DataFrame:
    """The drift test from kept counts alone."""
    ref = spark.read.parquet(f"{path}/reference").select("feature", "value", F.col("n").alias("c_ref"), F.lit(0).cast("long").alias("c_prod"))
    prod = kept_production(spark, path).filter("feature IS NOT NULL").select(
        "feature", "value", F.lit(0).cast("long").alias("c_ref"), F.col("n").alias("c_prod"))
    both = ref.unionByName(prod).groupBy("feature", "value").agg(F.sum("c_ref").alias("c_ref"), F.sum("c_prod").alias("c_prod"))
    return ks_from_counts(both, alpha)
