"""Keyed lookups into small derived dimensions.

A dimension is broadcast only after its rows, and its rows times the width of
its schema, have been checked against bounds; beyond them the join stays a shuffle join (and AQE may still turn
it into a broadcast at run time from the real shuffle sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import ensure_checkpoint_dir

# About 1M narrow rows is a few tens of MB per executor: safe to replicate.
MAX_BROADCAST_ROWS = 1_000_000
# Rows by the types' default widths (20 bytes a text, one element an array).
MAX_BROADCAST_BYTES = 256 << 20
# Bytes of input files for each partition of a table that is spread.
SPREAD_BYTES = 16 << 20


def materialize(dim: DataFrame) -> tuple[DataFrame, int]:
    """Write a (small) derived table to the shared checkpoint folder and count it.

    The reliable checkpoint cuts the lineage, so a lost executor re-reads the
    written files instead of re-running the aggregation that built the table.
    """
    ensure_checkpoint_dir(dim.sparkSession)
    dim = dim.checkpoint(eager=True)
    return dim, dim.count()


def lookup_join(df: DataFrame, dim: DataFrame, on, how: str = "left",
                dim_rows: int | None = None,
                max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left (or inner) equi-join to a dimension, broadcast if its size is proven small."""
    n = dim.count() if dim_rows is None else dim_rows
    if n <= max_rows and n * int(dim._jdf.schema().defaultSize()) <= MAX_BROADCAST_BYTES:
        dim = F.broadcast(dim)
    return df.join(dim, on, how)


def spread_for_heavy_work(df: DataFrame) -> DataFrame:
    """Give a table at least one partition per core before heavy per-row work.

    Used only in front of expensive steps (model fitting passes, ensemble
    scoring, the attribution walk).  A table that arrives in fewer partitions
    than the cluster has cores (a few small input files) is re-partitioned
    round-robin once; a large table already has more partitions and is left
    untouched, so no shuffle is added at scale.  No job is started to decide.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = bytes_read(df)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    # Spark cuts larger files into a task for each core by itself, down to their row groups.
    if size < cores * split // 4:
        return df.repartition(max(cores, size // SPREAD_BYTES))
    return df


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files a table is made from, or Spark's estimate for one of no files.

    Spark's estimate of a join is the product of its sides: a few small files seemed too large
    to spread.  Counting the partitions of an adaptive plan would run its shuffles.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    files = [x for x in leaves if x.getClass().getSimpleName() == "LogicalRelation"]
    return sum(int(str(x.stats().sizeInBytes())) for x in files) if files else int(str(plan.stats().sizeInBytes()))
