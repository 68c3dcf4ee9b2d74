"""Two-sample Kolmogorov-Smirnov drift between training data and the prediction log.

All monitored features are handled in one job: both sides are turned into a
long form (feature, value, side), counted per distinct value, run through an
exact ordered prefix sum per feature, and reduced to D = max |F_ref - F_prod|.
P-values are those of finite samples (``ks_pvalue``).  ``value_counts`` and ``ks_from_counts``
are the two halves of the job: counts by value can be kept and merged (``plans/drift_state``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import constants as K
from tarmac.operators.cumulative import exclusive_prefix
from tarmac.operators.ks_pvalue import p_value
from tarmac.session import ensure_checkpoint_dir

RESULT_SCHEMA = ("feature string, drift boolean, p_value double, ks_statistic double, "
                 "ref_mean double, prod_mean double, ref_std double, prod_std double")


def long_form(df: DataFrame, columns: dict[str, str], side: str) -> DataFrame:
    """(feature, value, side) rows for the present columns; nulls dropped per column."""
    present = {f: c for f, c in columns.items() if c in df.columns}
    if not present:
        return df.sparkSession.createDataFrame([], "feature string, value double, side string")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(c).cast("double").alias("value"))
        for f, c in present.items()]))
    return (df.select(pairs.alias("p")).select("p.feature", "p.value")
              .filter(F.col("value").isNotNull()).withColumn("side", F.lit(side)))


def value_counts(df: DataFrame, columns: dict[str, str], count: str = "n") -> DataFrame:
    """(feature, value, n): how often each value occurs, by monitored feature; nulls left out."""
    return long_form(df, columns, "any").groupBy("feature", "value").agg(F.count(F.lit(1)).alias(count))


def ks_drift(reference: DataFrame, production: DataFrame,
             features: list[tuple[str, str]] = K.DRIFT_FEATURES,
             alpha: float = K.DRIFT_ALPHA, buckets: int | None = None) -> DataFrame:
    """J1-J3 + F13: one row per monitored feature present on both sides with data.

    ``features`` lists (production column, reference column) pairs (D5).
    """
    prod_cols = {p: p for p, r in features}
    ref_cols = {p: r for p, r in features}
    both = long_form(reference, ref_cols, "ref").unionByName(long_form(production, prod_cols, "prod"))

    # The only pass over raw rows: counts per (feature, distinct value), with
    # map-side partial aggregation.  Everything after works on this table.
    per_value = both.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "ref").alias("c_ref"),
        F.count_if(F.col("side") == "prod").alias("c_prod"))
    return ks_from_counts(per_value, alpha, buckets)


def ks_from_counts(per_value: DataFrame, alpha: float = K.DRIFT_ALPHA, buckets: int | None = None) -> DataFrame:
    """The test from (feature, value, c_ref, c_prod), one row a feature and value.

    The counts are checkpointed once: they feed moments, cut points and prefix sums.
    """
    ensure_checkpoint_dir(per_value.sparkSession)
    per_value = per_value.checkpoint(eager=True)

    # mean and population std per (feature, side) from the weighted values,
    # centred on the mean in a second small pass (numerically stable).
    # ``sums``, ``centred``, ``moments`` and ``sizes`` hold one row per monitored
    # feature - at most len(features) rows - so broadcasting them is bounded.
    sums = per_value.groupBy("feature").agg(
        F.sum("c_ref").alias("n_ref"), F.sum("c_prod").alias("n_prod"),
        F.try_divide(F.sum(F.col("c_ref") * F.col("value")), F.sum("c_ref")).alias("ref_mean"),
        F.try_divide(F.sum(F.col("c_prod") * F.col("value")), F.sum("c_prod")).alias("prod_mean"))
    centred = per_value.join(F.broadcast(sums), "feature").groupBy("feature").agg(
        F.sqrt(F.try_divide(F.sum(F.col("c_ref") * (F.col("value") - F.col("ref_mean")) ** 2),
                            F.first("n_ref"))).alias("ref_std"),
        F.sqrt(F.try_divide(F.sum(F.col("c_prod") * (F.col("value") - F.col("prod_mean")) ** 2),
                            F.first("n_prod"))).alias("prod_std"))
    moments = sums.join(F.broadcast(centred), "feature")

    cum = exclusive_prefix(per_value, "value", ["c_ref", "c_prod"], groups=["feature"],
                           buckets=buckets)
    # one row per feature: broadcast the sizes.
    sizes = sums.select("feature", "n_ref", "n_prod").filter((F.col("n_ref") > 0) & (F.col("n_prod") > 0))
    gaps = cum.join(F.broadcast(sizes), "feature").withColumn(
        "gap", F.abs((F.col("cum_c_ref") + F.col("c_ref")) / F.col("n_ref")
                     - (F.col("cum_c_prod") + F.col("c_prod")) / F.col("n_prod")))
    d = gaps.groupBy("feature").agg(F.max("gap").alias("d"))
    res = d.join(F.broadcast(moments), "feature").filter((F.col("n_ref") > 0) & (F.col("n_prod") > 0))
    res = res.withColumn("p", p_value("n_ref", "n_prod", "d"))
    p = F.col("p")
    return res.select(
        "feature",
        (p < alpha).alias("drift"),
        F.round(p, 6).alias("p_value"),
        F.round("d", 6).alias("ks_statistic"),
        F.round("ref_mean", 4).alias("ref_mean"),
        F.round("prod_mean", 4).alias("prod_mean"),
        F.round("ref_std", 4).alias("ref_std"),
        F.round("prod_std", 4).alias("prod_std"),
    )


def gated_drift(reference: DataFrame, production: DataFrame,
                min_rows: int = K.DRIFT_MIN_ROWS, **kw) -> DataFrame:
    """Fewer than ``min_rows`` production rows -> empty result with the same schema."""
    n_prod = production.count()
    if n_prod < min_rows:
        return production.sparkSession.createDataFrame([], RESULT_SCHEMA)
    return ks_drift(reference, production, **kw)


def drift_report(result: DataFrame, n_reference: int, n_production: int,
                 generated_at: bool = True) -> DataFrame:
    """One row - time, both row counts, feature -> struct map, any drift."""
    entry = F.struct(*[c for c in result.columns if c != "feature"])
    cols = [F.lit(n_reference).cast("long").alias("n_reference"),
            F.lit(n_production).cast("long").alias("n_production"),
            F.map_from_entries(F.collect_list(F.struct("feature", entry))).alias("features"),
            F.coalesce(F.bool_or("drift"), F.lit(False)).alias("any_drift")]
    if generated_at:
        cols.insert(0, F.current_timestamp().alias("timestamp"))
    return result.agg(*cols)
