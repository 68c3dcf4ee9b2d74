"""The ETL job (P1): extract -> transform -> write, with a summary.

The input (its joins included) runs once: its rows, in the raw schema, are written to shared
storage, and the encoder fit, the write of the processed table and the row counts (two narrow
columns) read that copy.  The delay rate is one aggregate over the target of the processed table.
Observed metrics on the write would save the counting scan, but a session that has observed
anything cannot score with a freshly fitted logistic regression in this Spark version (its
training summary then holds an object that does not serialize).  The fitted category table is
written next to the processed table, so the scoring jobs use the same encoders.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import constants as K
from tarmac.operators.cleaning import removed_rows
from tarmac.plans.features import transform
from tarmac.session import shared_path
from tarmac.sources.files import RAW_SCHEMA, column_contract, conform, read_raw_csv, write_processed


def run_etl(spark: SparkSession, output_path: str, raw: DataFrame | None = None,
            input_path: str | None = None, fmt: str = "parquet") -> dict:
    """Returns the summary: rows in/out, columns, delay rate, seconds and the paths."""
    t0 = time.time()
    if raw is None:
        if input_path is None:
            raise ValueError("give a raw DataFrame or an input path")
        raw = read_raw_csv(spark, input_path)
    column_contract(raw, K.RAW_COLUMNS)          # warns on missing columns, goes on
    # The repeatable train/test split hashes a row key.  A source without one gets a hash of
    # the row's own values: stable, and equal rows share a side.
    key = F.col("flight_key") if "flight_key" in raw.columns else \
        F.xxhash64(*[F.col(c) for c in K.RAW_COLUMNS if c in raw.columns]).cast("string")
    raw = conform(raw.withColumn("flight_key", key),
                  T.StructType([T.StructField("flight_key", T.StringType())] + RAW_SCHEMA.fields))
    staged = shared_path(spark, "etl-raw", unique=True)
    raw.write.parquet(staged)
    raw = spark.read.parquet(staged)
    processed, categories = transform(raw, keep_key=True)
    write_processed(processed, output_path, fmt)
    categories.save(f"{output_path}_categories")
    written = spark.read.parquet(output_path) if fmt == "parquet" else \
        spark.read.option("header", True).csv(output_path)
    counts = removed_rows(raw).first()
    return {
        "output_path": output_path,
        "rows_in": counts["rows_in"],
        "rows_out": counts["rows_out"],
        "columns": len(written.columns),
        "delay_rate": written.agg(F.avg(K.TARGET)).first()[0],
        "seconds": round(time.time() - t0, 2),
    }
