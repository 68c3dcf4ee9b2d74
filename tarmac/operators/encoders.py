"""Fitted encoders: label codes, frequency shares, pinned one-hots, scaler.

Fitting is one aggregation pass; the fitted state is a small long-form table
``(kind, value, n, code, share)`` written to shared storage, then joined back
by size-checked broadcast lookups.  Nothing of data size goes to the driver:
only the scaler's single row of moments (two numbers per feature) is read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.joins import MAX_BROADCAST_ROWS, lookup_join, materialize

# Above this many distinct values the ordinal code is computed by a
# distributed sorted index instead of one ordered window.
MAX_WINDOW_ROWS = 1_000_000


def category_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Counts of non-null values of several columns in one scan.

    ``columns`` maps a kind name to a column.  Rows are turned into
    (kind, value) pairs and counted with map-side partial aggregation, so the
    shuffle carries at most one row per distinct value per task.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("value"))
        for kind, col in columns.items()]))
    return (df.select(pairs.alias("p")).select("p.kind", "p.value")
              .filter(F.col("value").isNotNull())
              .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))


def ordinal_codes(values: DataFrame, rows: int, value: str = "value",
                  code: str = "code", partition_by: str | None = None) -> DataFrame:
    """0-based position of each distinct value in ascending order (dense rank - 1).

    Small sets (checked ``rows``) use one ordered window.  Large sets use a
    sorted, checkpointed copy: partition sizes -> offsets -> position inside
    the partition, so no task ever holds more than its own range.
    """
    if rows <= MAX_WINDOW_ROWS:
        w = Window.orderBy(value) if partition_by is None else \
            Window.partitionBy(partition_by).orderBy(value)
        return values.withColumn(code, (F.row_number().over(w) - 1).cast("int"))
    if partition_by is not None:
        raise ValueError("large ordinal codes are built one kind at a time")
    ranked = values.orderBy(value).checkpoint(eager=True)
    ranked = ranked.withColumn("_pid", F.spark_partition_id()) \
                   .withColumn("_mid", F.monotonically_increasing_id())
    sizes = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn(
        "_offset",
        F.coalesce(F.sum("_size").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition of the sorted copy: bounded by the partition count
    ranked = ranked.join(F.broadcast(offsets.select("_pid", "_offset")), "_pid")
    pos = F.col("_offset") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    return ranked.withColumn(code, pos.cast("int")).drop("_pid", "_mid", "_offset")


def shares(counts: DataFrame) -> DataFrame:
    """Per kind: n / total of non-null rows (value_counts(normalize=True))."""
    totals = counts.groupBy("kind").agg(F.sum("n").alias("_total"))
    # one row per kind (one per counted column): a bounded broadcast
    return counts.join(F.broadcast(totals), "kind") \
                 .withColumn("share", F.col("n") / F.col("_total")).drop("_total")


@dataclass
class CategoryModel:
    """Fitted label codes and shares for the flight categorical columns."""
    table: DataFrame            # kind, value, n, code, share
    rows: int
    carrier: str = "Reporting_Airline"
    origin: str = "Origin"
    dest: str = "Dest"

    @classmethod
    def fit(cls, df: DataFrame, carrier: str = "Reporting_Airline",
            origin: str = "Origin", dest: str = "Dest") -> "CategoryModel":
        counts = category_counts(df, {"carrier": carrier, "origin": origin, "dest": dest})
        counts, n = materialize(counts)
        coded = ordinal_codes(counts, n, partition_by="kind") if n <= MAX_WINDOW_ROWS else \
            _codes_by_kind(counts)
        table, rows = materialize(shares(coded))
        return cls(table, rows, carrier, origin, dest)

    def lookup(self, kind: str, value_name: str, out: dict[str, str]) -> DataFrame:
        sel = [F.col("value").alias(value_name)] + [F.col(src).alias(dst) for src, dst in out.items()]
        return self.table.filter(F.col("kind") == kind).select(*sel)

    def transform(self, df: DataFrame, carrier_code: str = "carrier_encoded",
                  origin_share: str = "origin_freq", dest_share: str = "dest_freq",
                  keys: dict[str, str] | None = None) -> DataFrame:
        """Left lookups; unseen values get null (filled with 0 by the final fill).

        ``keys`` overrides the column holding each kind (carrier/origin/dest).
        """
        keys = {"carrier": self.carrier, "origin": self.origin, "dest": self.dest, **(keys or {})}
        n = max(self.rows, 0)
        df = lookup_join(df, self.lookup("carrier", keys["carrier"], {"code": carrier_code}),
                         keys["carrier"], "left", dim_rows=n, max_rows=MAX_BROADCAST_ROWS)
        df = lookup_join(df, self.lookup("origin", keys["origin"], {"share": origin_share}),
                         keys["origin"], "left", dim_rows=n)
        df = lookup_join(df, self.lookup("dest", keys["dest"], {"share": dest_share}),
                         keys["dest"], "left", dim_rows=n)
        return df

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, **names) -> "CategoryModel":
        t = spark.read.parquet(path)
        return cls(t, t.count(), **names)


def _codes_by_kind(counts: DataFrame) -> DataFrame:
    parts = []
    for kind in ("carrier", "origin", "dest"):
        sub, n = materialize(counts.filter(F.col("kind") == kind))
        parts.append(ordinal_codes(sub, n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- standard scaler (E4) ----------------------------------------------------

@dataclass
class ScalerModel:
    """(x - mean) / population std; a zero std divides by 1."""
    features: list[str]
    means: list[float]
    stds: list[float]

    @staticmethod
    def aggregates(features: list[str], where=None) -> list:
        """Mean and population std of each feature (optionally of the rows in ``where``).

        Returned as aggregate columns so callers can fuse them with other
        statistics into one pass.
        """
        aggs = []
        for i, c in enumerate(features):
            x = F.col(c).cast("double")
            if where is not None:
                x = F.when(where, x)
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        return aggs

    @classmethod
    def from_row(cls, row, features: list[str]) -> "ScalerModel":
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(features))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(features))]
        return cls(list(features), means, stds)

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> "ScalerModel":
        row = df.agg(*cls.aggregates(features)).first()  # one row: two numbers per feature
        return cls.from_row(row, features)

    def scale(self) -> list[float]:
        return [s if s > 0 else 1.0 for s in self.stds]

    def columns(self, suffix: str = "") -> list:
        return [((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c + suffix)
                for c, m, s in zip(self.features, self.means, self.scale())]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = keep or [c for c in df.columns if c not in self.features]
        return df.select(*keep, *self.columns())

    def to_frame(self, spark) -> DataFrame:
        rows = [(f, m, s, sc) for f, m, s, sc in zip(self.features, self.means, self.stds, self.scale())]
        return spark.createDataFrame(rows, "feature string, mean double, std double, scale double")

    @classmethod
    def from_frame(cls, df: DataFrame, order: list[str]) -> "ScalerModel":
        got = {r["feature"]: r for r in df.collect()}  # one row per feature
        return cls(list(order), [got[f]["mean"] for f in order], [got[f]["std"] for f in order])
