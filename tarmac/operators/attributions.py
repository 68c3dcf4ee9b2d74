"""Per-row additive feature attributions.

Linear models: exact, ``coef_j * (x_j - mean_j)`` computed by ``zip_with`` on
arrays inside the JVM; base = intercept + coef . mean, so base + sum = margin.

Tree ensembles: path contributions.  Walking a row from the root to its leaf,
each split on feature f moves the node value from parent to child; that
difference is credited to f.  Summed over trees (times the tree weight),
base + sum of contributions = the ensemble output (GBT margin, or the
forest's averaged class-1 probability).  The node tables are read from the
saved model, size-checked, broadcast once, and applied per Arrow batch with
``mapInPandas`` - NumPy walks all rows of a batch through a tree together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.joins import spread_for_heavy_work

# A forest of 200 trees of depth 15 has up to ~13M nodes; beyond this the
# tables are not broadcast.
MAX_BROADCAST_NODES = 20_000_000


def linear_attributions(df: DataFrame, model, features_col: str = "features",
                        reference_mean: list[float] | None = None) -> DataFrame:
    """Adds base, contributions (array) and margin for a logistic regression."""
    coefs = model.coefficients.toArray().tolist()
    mean = reference_mean or [0.0] * len(coefs)
    base = float(model.intercept) + float(np.dot(coefs, mean))
    x = vector_to_array(features_col)
    c = F.array(*[F.lit(float(v)) for v in coefs])
    m = F.array(*[F.lit(float(v)) for v in mean])
    contrib = F.zip_with(F.zip_with(x, m, lambda a, b: a - b), c, lambda d, w: d * w)
    margin = F.lit(float(model.intercept)) + F.aggregate(
        F.zip_with(x, c, lambda a, w: a * w), F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumn("base", F.lit(base)).withColumn("contributions", contrib) \
             .withColumn("margin", margin)


def feature_means(df: DataFrame, n: int, features_col: str = "features") -> list[float]:
    """Mean of each vector slot (one row of n numbers); the reference point."""
    arr = vector_to_array(features_col)
    row = df.agg(*[F.avg(arr[i]).alias(f"m{i}") for i in range(n)]).first()
    return [float(row[f"m{i}"] or 0.0) for i in range(n)]


def _tree_tables(spark: SparkSession, model_path: str, kind: str):
    """Flat NumPy node tables from a saved tree ensemble."""
    nodes = spark.read.parquet(f"{model_path}/data")
    n_nodes = nodes.count()
    if n_nodes > MAX_BROADCAST_NODES:
        raise ValueError(f"{n_nodes} nodes: too large to broadcast for attributions")
    if nodes.filter("nodeData.leftChild >= 0 AND nodeData.split.numCategories >= 0").limit(1).count():
        raise ValueError("categorical splits have no threshold: this walk is for continuous features")
    weights_df = spark.read.parquet(f"{model_path}/treesMetadata")
    wcol = weights_df.columns
    weights = {int(r[0]): float(r[2]) for r in weights_df.select(wcol[0], wcol[1], wcol[2]).collect()}
    pdf = nodes.select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("pred"),
        F.col("nodeData.impurityStats").alias("stats"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feat"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("thr"),
    ).toPandas()  # bounded by the node-count check above
    trees = []
    for tid, g in pdf.groupby("treeID"):
        g = g.sort_values("id")
        size = int(g["id"].max()) + 1
        left = np.full(size, -1, np.int64)
        right = np.full(size, -1, np.int64)
        feat = np.full(size, -1, np.int64)
        thr = np.zeros(size)
        val = np.zeros(size)
        ids = g["id"].to_numpy()
        left[ids] = g["left"].to_numpy()
        right[ids] = g["right"].to_numpy()
        feat[ids] = g["feat"].fillna(-1).to_numpy()
        thr[ids] = g["thr"].fillna(0.0).to_numpy()
        if kind == "forest":
            # class-1 share of the (weighted) class counts at each node
            val[ids] = [float(s[1]) / float(sum(s)) if s is not None and sum(s) > 0 else 0.0
                        for s in g["stats"]]
        else:
            val[ids] = g["pred"].to_numpy()
        trees.append((weights.get(int(tid), 1.0), left, right, feat, thr, val))
    scale = 1.0 / len(trees) if kind == "forest" else 1.0
    return trees, scale


def tree_attributions(df: DataFrame, model_path: str, n_features: int, kind: str = "gbt",
                      key: str = "request_id", features_col: str = "features") -> DataFrame:
    """(key, base, contributions, output) per row; ``kind`` is 'gbt' or 'forest'."""
    spark = df.sparkSession
    trees, scale = _tree_tables(spark, model_path, kind)
    bc = spark.sparkContext.broadcast(trees)
    base = scale * sum(w * val[0] for w, _l, _r, _f, _t, val in trees)  # root values

    def walk(batches):
        forest = bc.value
        for pdf in batches:
            x = np.vstack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, n_features))
            contrib = np.zeros((len(pdf), n_features))
            rows = np.arange(len(pdf))
            for w, left, right, feat, thr, val in forest:
                node = np.zeros(len(pdf), np.int64)
                active = left[node] >= 0
                while active.any():
                    r = rows[active]
                    nd = node[active]
                    f = feat[nd]
                    go_left = x[r, f] <= thr[nd]
                    child = np.where(go_left, left[nd], right[nd])
                    contrib[r, f] += w * scale * (val[child] - val[nd])  # a row has one step here
                    node[active] = child
                    active = left[node] >= 0
            yield pd.DataFrame({key: pdf[key].to_numpy(),
                                "base": np.full(len(pdf), base),
                                "contributions": list(contrib),
                                "output": base + contrib.sum(axis=1)})

    inp = spread_for_heavy_work(df.select(key, vector_to_array(features_col).alias("x")))
    return inp.mapInPandas(walk, f"{key} string, base double, contributions array<double>, "
                                 f"output double")
