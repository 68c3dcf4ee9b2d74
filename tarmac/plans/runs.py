"""Experiment run log as a table.

A run is one row: id, name, start/end time and three maps (params, metrics,
tags).  Runs are appended to a Parquet table in shared storage, so "search
runs" is ordinary DataFrame code.  ``scan_run_store`` imports an existing
file-per-value tracking folder into the same row shape.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS_SCHEMA = ("run_id string, run_name string, start_time timestamp, end_time timestamp, "
               "params map<string,string>, metrics map<string,double>, tags map<string,string>")


def log_run(spark: SparkSession, path: str, run_name: str, params: dict, metrics: dict,
            tags: dict | None = None, model_type: str | None = None,
            start_time: dt.datetime | None = None, end_time: dt.datetime | None = None) -> str:
    """Append one run; a ``model_type`` tag is always set (to the run name by default)."""
    run_id = uuid.uuid4().hex
    tags = dict(tags or {})
    tags["model_type"] = model_type or run_name
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = (run_id, run_name, start_time or now, end_time or now,
           {str(k): str(v) for k, v in params.items()},
           {str(k): float(v) for k, v in metrics.items()},
           {str(k): str(v) for k, v in tags.items()})
    spark.createDataFrame([row], RUNS_SCHEMA).write.mode("append").parquet(path)
    return run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(path)


def best_run(runs: DataFrame, metric: str = "f1_score", ascending: bool = False) -> DataFrame:
    """The best run by a metric; runs without that metric sort last; empty -> no row.

    Ties are broken by start time (earliest first), then run id.
    """
    m = F.col("metrics")[metric]
    order = m.asc_nulls_last() if ascending else m.desc_nulls_last()
    return runs.orderBy(order, "start_time", "run_id").limit(1)


def scan_run_store(spark: SparkSession, root: str) -> DataFrame:
    """A tracking folder of one-value files -> one row per run.

    Layout: ``<run>/metrics/<name>`` holds "millis value step" lines (the last
    line wins), ``<run>/params/<name>`` and ``<run>/tags/<name>`` a bare value,
    ``<run>/meta.yaml`` the run name and times (epoch millis).  Only these files are read (a
    run's artifacts are not), many of them a task.
    """
    try:
        found = spark.read.option("recursiveFileLookup", True).text(f"{root}/*/*", wholetext=True)
    except AnalysisException as e:  # no runs
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS_SCHEMA)
    # One listing, by tasks, for all kinds.  Places are counted from the root: a run's artifacts
    # may hold a folder that looks like a run.
    path = F.col("_metadata.file_path")
    parts = F.split(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    deep = len(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/").split("/"))

    def files(pattern: str, depth: int) -> DataFrame:
        """Text and path of the files of a kind, each read once, many a task."""
        rows = found.filter(path.rlike(pattern) & (F.size(parts) == deep + depth)).select(F.col("value").alias("text"), path.alias("path"))
        # Spark counts 4 MB for opening a file, so tiny files would make a task for every 32.
        return rows.coalesce(spark.sparkContext.defaultParallelism)

    value = r"/([0-9a-f]{32})/(metrics|params|tags)/([^/]+)$"
    kv = files(value, 4).select(
        F.regexp_extract("path", value, 1).alias("run_id"), F.regexp_extract("path", value, 2).alias("kind"),
        F.regexp_extract("path", value, 3).alias("name"),
        F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))  # trim() keeps newlines
    lines = F.filter(F.split(F.col("text"), r"\n"), lambda ln: F.length(F.trim(ln)) > 0)
    last_line = F.try_element_at(lines, F.lit(-1))
    metric_value = F.try_element_at(F.split(F.trim(last_line), r"\s+"), F.lit(2)).cast("double")
    per_run = kv.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "params",
                                                 F.struct("name", "text")))).alias("params"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "metrics",
                                                 F.struct(F.col("name"), metric_value)))).alias("metrics"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "tags",
                                                 F.struct("name", "text")))).alias("tags"))
    meta = (files(r"/[0-9a-f]{32}/meta\.yaml$", 3)
            .select(F.regexp_extract("path", r"/([0-9a-f]{32})/meta\.yaml$", 1).alias("run_id"),
                    F.regexp_extract("text", r"(?m)^run_name:\s*(.*)$", 1).alias("run_name"),
                    F.timestamp_millis(F.regexp_extract("text", r"(?m)^start_time:\s*(\d+)", 1)
                                       .cast("long")).alias("start_time"),
                    F.timestamp_millis(F.regexp_extract("text", r"(?m)^end_time:\s*(\d+)", 1)
                                       .cast("long")).alias("end_time")))
    return meta.join(per_run, "run_id", "left").select(
        "run_id", "run_name", "start_time", "end_time", "params", "metrics", "tags")
