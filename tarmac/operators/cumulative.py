"""Exact ordered prefix sums without a global (single-task) window.

Used by the two-sample KS statistic and the tie-aware ROC AUC, which both
need the empirical CDF over all distinct values of a column.

Plan:
1. ``percentile_approx`` per group gives ~``buckets`` cut points (one small row
   per group, broadcast back after a size check);
2. each row's bucket = number of cuts strictly below its value (monotone in
   the value, so buckets are ordered ranges);
3. bucket totals (groups x buckets rows) get a prefix sum over the bucket
   order - a tiny window;
4. rows get a window prefix sum *inside* their (group, bucket) partition plus
   their bucket's offset.

The approximation only affects how evenly buckets are filled, never the
result, which is exact.  Input rows are normally pre-aggregated per distinct
value, so a value carrying a third of all raw rows is still a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.joins import lookup_join

DEFAULT_BUCKETS = 256


def range_count(df: DataFrame, range_bytes: int = 32 << 20, most: int = 65_536) -> int:
    """Ranges by Spark's size estimate of the input, about 32 MB each (starts no job)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # no estimate
        return DEFAULT_BUCKETS
    return min(most, max(DEFAULT_BUCKETS, size // range_bytes))


def _cuts_below(value, buckets: int):
    """How many of the sorted ``_cuts`` are smaller than ``value``: a binary search."""
    steps = F.array(*[F.lit(1 << i) for i in range(max(1, buckets.bit_length()) - 1, -1, -1)])

    def walk(at, step):
        nxt = at + step
        return F.when((nxt <= F.size("_cuts")) & (F.try_element_at(F.col("_cuts"), nxt) < value), nxt).otherwise(at)
    return F.aggregate(steps, F.lit(0), walk)


def exclusive_prefix(df: DataFrame, order: str, sums: list[str],
                     groups: list[str] | None = None,
                     buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows of the same group with a smaller ``order``.

    ``order`` must be unique within a group (aggregate by value first).
    """
    # Without groups all rows are one group: its row of cut points is broadcast all the same.
    alone = not groups
    groups = ["_all"] if alone else list(groups)
    df = df.withColumn("_all", F.lit(0)) if alone else df
    buckets = buckets or range_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = F.array_distinct(F.percentile_approx(F.col(order), probs, min(100_000, 10 * buckets))).alias("_cuts")
    # One row of cut points per group (e.g. per monitored feature); the
    # row count is checked before the broadcast.
    cut_rows = df.groupBy(*groups).agg(cuts)
    n_groups = 1 if alone else cut_rows.count()
    with_cuts = lookup_join(df, cut_rows, groups, "inner", dim_rows=n_groups)
    below = _cuts_below(F.col(order), buckets)
    bucketed = with_cuts.withColumn("_bucket", below).drop("_cuts")

    keys = groups + ["_bucket"]
    totals = bucketed.groupBy(*keys).agg(*[F.sum(c).alias(f"_bt_{c}") for c in sums])
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[
        F.coalesce(F.sum(f"_bt_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums])
    # offsets has at most groups x buckets rows: broadcast under the usual check.
    joined = lookup_join(bucketed, offsets, keys, "inner", dim_rows=n_groups * buckets)
    inside = Window.partitionBy(*keys).orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    out = joined
    for c in sums:
        out = out.withColumn(prefix + c,
                             F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_bucket", *[f"_off_{c}" for c in sums], *(groups if alone else []))
