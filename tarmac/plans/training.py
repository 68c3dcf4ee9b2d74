"""Split, scale, fit, evaluate, select and persist the delay classifiers.

The processed table is split by a keyed hash (row-local, repeatable, no
shuffle), written once, scaled with the population-std scaler and assembled:
the three estimators then fit on that one written table, each fit being a
set of distributed Spark ML jobs.  Hold-out metrics are computed by the
distributed metric operators, never by collecting predictions.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier,
                                       LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.functions import constants as K
from tarmac.operators.encoders import ScalerModel
from tarmac.operators.joins import bytes_read, materialize, spread_for_heavy_work
from tarmac.operators.metrics import class_metrics, class_report, confusion, roc_auc
from tarmac.operators.trees import fits, grow_boosted, grow_forest, predicted
from tarmac.plans import runs as R
from tarmac.session import shared_path

# --- H1: keyed hash split -------------------------------------------------------


def hash_bucket(key, seed: int = K.SPLIT_SEED):
    """First 32 bits of md5(key || seed) as a non-negative integer."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_split_flag(key: str = "flight_key", seed: int = K.SPLIT_SEED,
                    test_fraction: float = K.TEST_FRACTION):
    """1 for the hold-out rows: hash % d < n for a fraction of n / d (d up to 1000).

    Equal keys share a side, rows without a key too.
    """
    part = Fraction(test_fraction).limit_denominator(1000)
    return (hash_bucket(key, seed) % part.denominator < part.numerator).cast("int")


def stratified_split_flag(df: DataFrame, key: str = "flight_key", label: str = K.TARGET,
                          seed: int = K.SPLIT_SEED, test_fraction: float = K.TEST_FRACTION):
    """The flag of ``stratified_cuts``; rows without a label are not held out."""
    return cuts_flag(stratified_cuts(df, key, label, seed, test_fraction), key, label, seed)


def cuts_flag(cuts: dict, key: str = "flight_key", label: str = K.TARGET, seed: int = K.SPLIT_SEED):
    """1 where the row's hash is below its class's cut."""
    flag = F.lit(0)
    for y, c in cuts.items():
        flag = F.when(F.col(label) == y, (hash_bucket(key, seed) < F.lit(c)).cast("int")).otherwise(flag)
    return flag


def stratified_cuts(df: DataFrame, key: str = "flight_key", label: str = K.TARGET,
                    seed: int = K.SPLIT_SEED, test_fraction: float = K.TEST_FRACTION) -> dict:
    """Exact-count stratified hold-out flag (per class ceil(fraction * n_c) rows).

    Rows are ordered by the md5 hash of their key within each class; the cut
    for a class is the first hash at which the number of rows before it
    reaches the target.  Rows are counted by the first 12 bits of the hash, then,
    in the one range that holds the cut, by the whole hash: only counts are
    shuffled (at most 4,096 and 2^21 a class); the cuts (one number per class) come back
    to the driver and the flag is a plain column expression - no join back.
    Equal keys stay on one side, so a class may exceed its target by the size
    of one duplicate group; a class that is one group is held out whole.
    """
    frac = Fraction(test_fraction).limit_denominator(1000)
    known = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_y"), hash_bucket(key, seed).alias("_h")) \
        .withColumn("_r", F.shiftright("_h", 20))
    in_order = Window.partitionBy("_y")
    ranges = known.groupBy("_y", "_r").agg(F.count(F.lit(1)).alias("_n")).select(
        "_y", "_r", "_n", F.sum("_n").over(in_order.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        # The cut is in the next range where the target is the end of this one.
        F.lead("_r").over(in_order.orderBy("_r")).alias("_next"), F.sum("_n").over(in_order).alias("_t"))
    target = F.expr(f"(_t * {frac.numerator} + {frac.denominator - 1}) div {frac.denominator}")
    found = ranges.filter(F.col("_upto") >= target).groupBy("_y").agg(
        F.min(F.struct("_r", "_next", (F.col("_upto") - F.col("_n")).alias("before"), target.alias("target"))).alias("at")) \
        .select("_y", "at.*").collect()   # one row per class
    if not found:
        return {}
    here, missing = F.lit(False), F.lit(None).cast("long")
    for r in found:
        mine = F.col("_y") == r["_y"]
        here = here | (mine & F.col("_r").isin([x for x in (r["_r"], r["_next"]) if x is not None]))
        missing = F.when(mine, F.lit(r["target"] - r["before"])).otherwise(missing)
    before = F.sum("_n").over(in_order.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))
    cuts = {r["_y"]: r["_c"] for r in known.filter(here).groupBy("_y", "_h").agg(F.count(F.lit(1)).alias("_n"))
            .select("_y", "_h", F.coalesce(before, F.lit(0)).alias("_before"))
            .filter(F.col("_before") >= missing).groupBy("_y").agg(F.min("_h").alias("_c")).collect()}
    # No hash with enough rows before it: the target takes the last group too.
    return {r["_y"]: int(cuts.get(r["_y"], 1 << 32)) for r in found}


# --- presets and estimators (H2-H5) ---------------------------------------------

@dataclass
class Preset:
    lr_iter: int
    rf_trees: int
    rf_depth: int
    gbt_iter: int
    gbt_depth: int
    models: tuple = ("LogisticRegression", "RandomForest", "GradientBoosting")


# "reference" is the original configuration; "quick" keeps driver checks and
# tests short.  Model size is a parameter, never silently changed.
PRESETS = {
    "reference": Preset(1000, 200, 15, 200, 6),
    "quick": Preset(100, 20, 8, 20, 4),
}


#: A forest is fitted as this many forests of fewer trees, whatever the cluster.
FOREST_PARTS = 8
#: Bytes for the statistics of a forest's nodes in a pass, of all its parts together.
FOREST_MEMORY_MB = 1024


def make_estimator(name: str, preset: Preset, n_train: float):
    """Spark ML estimator with the original settings mapped across.

    Logistic regression: L2, C = 1 and balanced weights n/(2 n_c).  Spark's
    objective is the weight-normalised loss + regParam/2 |w|^2, so C = 1
    corresponds to regParam = 1 / sum(weights) = 1 / n_train.  The stopping
    tolerance is the original solver's default (1e-4) rather than Spark's 1e-6.
    """
    if name == "LogisticRegression":
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                  maxIter=preset.lr_iter, regParam=1.0 / max(n_train, 1.0),
                                  elasticNetParam=0.0, standardization=False, tol=1e-4)
    if name == "RandomForest":
        # Deep trees: cache each row's node id between passes instead of
        # re-walking every tree from the root, and let one pass split more
        # nodes.  Both are speed settings only (same model for the same seed).
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                      numTrees=preset.rf_trees, maxDepth=preset.rf_depth,
                                      featureSubsetStrategy="sqrt", seed=K.SPLIT_SEED,
                                      cacheNodeIds=True, maxMemoryInMB=FOREST_MEMORY_MB)
    if name in ("GradientBoosting", "XGBoost"):
        # H5 (the alternative booster) has the same size and rate with log loss.
        return GBTClassifier(featuresCol="features", labelCol="label",
                             maxIter=preset.gbt_iter, maxDepth=preset.gbt_depth, stepSize=0.1,
                             lossType="logistic", seed=K.SPLIT_SEED)
    raise ValueError(name)


def model_params(name: str, preset: Preset) -> dict:
    return {
        "LogisticRegression": {"max_iter": preset.lr_iter, "class_weight": "balanced",
                               "solver": "lbfgs"},
        "RandomForest": {"n_estimators": preset.rf_trees, "max_depth": preset.rf_depth,
                         "class_weight": "balanced"},
        "GradientBoosting": {"n_estimators": preset.gbt_iter, "max_depth": preset.gbt_depth,
                             "learning_rate": 0.1},
        "XGBoost": {"n_estimators": preset.gbt_iter, "max_depth": preset.gbt_depth,
                    "learning_rate": 0.1, "eval_metric": "logloss"},
    }.get(name, {})


# --- preparation -------------------------------------------------------------------

def feature_columns(df: DataFrame) -> list[str]:
    """Every column except the meta/target columns (and the row key)."""
    skip = set(K.EXCLUDE_COLUMNS) | {"flight_key", "is_test"}
    return [c for c in df.columns if c not in skip]


@dataclass
class Prepared:
    data: DataFrame              # key, is_test, label, weight, features (written)
    features: list[str]
    scaler: ScalerModel
    class_weights: dict
    n_train: int
    n_test: int
    split: dict = field(default_factory=dict)


def split_flag(split: dict):
    """The hold-out flag of saved split settings."""
    if split["mode"] == "stratified":
        return cuts_flag({int(y): c for y, c in split["cuts"].items()}, split["key"], seed=split["seed"])
    return hash_split_flag(split["key"], split["seed"], split["fraction"])


def prepare(processed: DataFrame, key: str = "flight_key", scaler_fit: str = "train",
            split: str = "hash", test_fraction: float = K.TEST_FRACTION) -> Prepared:
    """Split flag, balanced weights, scaler fit, assembled vector - from one table in shared storage.

    ``scaler_fit='all'`` reproduces the original (the scaler also sees test rows).
    ``split='stratified'`` uses exact per-class hold-out counts instead of the
    row-local hash threshold.
    """
    feats = feature_columns(processed)
    settings = {"mode": split, "key": key, "seed": K.SPLIT_SEED, "fraction": test_fraction}
    if split == "stratified":
        settings["cuts"] = stratified_cuts(processed, key, test_fraction=test_fraction)
    df = processed.withColumn("is_test", split_flag(settings)).select(key, "is_test", K.TARGET, *feats)
    # The flights are derived once and written to shared storage, spread over all cores (a no-op for a
    # table that is already large): moments and estimators read that, a lost executor costs nothing, and
    # nothing stays cached when the job is over.
    path = shared_path(processed.sparkSession, "training-set", unique=True)
    spread_for_heavy_work(df).write.parquet(path)
    df = processed.sparkSession.read.parquet(path)
    # One pass for the scaler moments (of the fitting rows) and the class counts.
    in_fit = None if scaler_fit == "all" else (F.col("is_test") == 0)
    counts_aggs = [F.count_if((F.col("is_test") == t) & (F.col(K.TARGET) == y)).alias(f"n{t}{y}")
                   for t in (0, 1) for y in (0, 1)]
    row = df.agg(*ScalerModel.aggregates(feats, in_fit), *counts_aggs).first()
    scaler = ScalerModel.from_row(row, feats)
    n0, n1 = row["n00"], row["n01"]
    n_train, n_test = n0 + n1, row["n10"] + row["n11"]
    w = {0: n_train / (2.0 * n0) if n0 else 0.0, 1: n_train / (2.0 * n1) if n1 else 0.0}
    scaled = df.select(key, "is_test", F.col(K.TARGET).cast("double").alias("label"),
                       F.when(F.col(K.TARGET) == 1, F.lit(w[1])).otherwise(F.lit(w[0])).alias("weight"),
                       *scaler.columns())
    assembled = VectorAssembler(inputCols=feats, outputCol="features").transform(scaled) \
        .select(key, "is_test", "label", "weight", "features")
    # Scaled and assembled once as well: each task of a fit gets the whole plan of its rows, and boosting
    # has a job a level, so it reads a table that needs no further step.
    path = shared_path(processed.sparkSession, "training-vectors", unique=True)
    assembled.write.parquet(path)
    return Prepared(processed.sparkSession.read.parquet(path), feats, scaler, w, n_train, n_test, settings)


# --- evaluation (F14-F17 on model output) ----------------------------------------

def positive_probability(pred: DataFrame) -> DataFrame:
    """p(delayed); a model without probabilities gives p = predicted class."""
    if "p" in pred.columns:
        return pred
    if "probability" in pred.columns:
        return pred.withColumn("p", vector_to_array("probability")[1])
    return pred.withColumn("p", F.col("prediction"))


def evaluate_predictions(pred: DataFrame, digits: int | None = 4) -> dict:
    """Accuracy, precision, recall, F1 and ROC AUC from distributed aggregates."""
    scored = positive_probability(pred).select(
        F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"), F.col("p").alias("score"))
    # The model runs once over the hold-out: its answers are counted and the counts kept.
    counts, _n = materialize(scored.groupBy("label", "prediction", "score").agg(F.count(F.lit(1)).alias("rows")))
    conf = confusion(counts, weight="rows")
    m = class_metrics(conf).first().asDict()
    auc = roc_auc(counts, weight="rows").first()["roc_auc"]
    m["roc_auc"] = float(auc) if auc is not None else 0.0
    if digits is not None:
        m = {k: round(v, digits) for k, v in m.items()}
    return m


# --- H6: train all -----------------------------------------------------------------

#: Parts of the cores that fits side by side get. A forest's passes are long tasks, boosting is some
#: 1,400 short jobs one after the other: were each as wide as the cluster, it would wait for every pass.
CORE_SHARES = {"LogisticRegression": 1, "RandomForest": 5, "GradientBoosting": 7, "XGBoost": 7}
#: Bytes of files for each partition of a training set at most; a larger set has more partitions than its share.
LANE_BYTES = 64 << 20
#: Rows for each partition of a fit at least: a pass over fewer takes less time than the task around it, and
#: tasks go to the executor that keeps their rows, where they wait if another fit has its cores.
LANE_ROWS = 100_000


def lane_width(cores: int, name: str, side_by_side: list[str]) -> int:
    """Cores of a model that is fitted beside others; all of them if it is alone."""
    if len(side_by_side) < 2:
        return cores
    return max(2, cores * CORE_SHARES.get(name, 1) // sum(CORE_SHARES.get(n, 1) for n in side_by_side))


def own_lane(train: DataFrame, name: str, side_by_side: list[str], rows: int | None = None) -> DataFrame:
    """All rows of the training set, in as many partitions as a model's share of the cores; in fewer
    if the set is known to have few ``rows``."""
    lane = lane_width(train.sparkSession.sparkContext.defaultParallelism, name, side_by_side)
    if rows is not None:
        lane = min(lane, max(1, rows // LANE_ROWS))
    return train.coalesce(max(lane, -(-bytes_read(train) // LANE_BYTES)))


def fit_forest(est: RandomForestClassifier, train: DataFrame, cores: int):
    """A forest, fitted as forests of fewer trees, as many at a time as ``cores`` have room for.

    Every tree has its own bootstrap of all training rows and its own choices of features, so trees of
    several fits make one forest. Each task of a pass makes and sends the statistics of all nodes of the
    pass: few partitions a fit make fewer of them, and no fit waits for the slowest task of another.
    """
    spark = train.sparkSession
    partitions = max(1, -(-bytes_read(train) // LANE_BYTES))
    # Parts and partitions follow the input alone: a larger cluster gives the same forest.
    rows, total = train.coalesce(partitions), est.getNumTrees()
    parts = min(FOREST_PARTS, total)
    side_by_side = min(parts, max(1, cores // partitions))
    fits = [est.copy({est.numTrees: total // parts + (i < total % parts),
                      est.seed: est.getSeed() + 1_000_003 * i,   # partitions add small numbers to it
                      est.maxMemoryInMB: max(1, est.getMaxMemoryInMB() // side_by_side)}) for i in range(parts)]
    with ThreadPoolExecutor(side_by_side) as pool:
        found = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(e.fit), rows) for e in fits]]
    return one_forest(est, found)


def one_forest(est: RandomForestClassifier, parts: list) -> RandomForestClassificationModel:
    """The trees of several forests as one model with the parameters of ``est``."""
    trees = [t for m in parts for t in m._java_obj.trees()]
    context = SparkContext._active_spark_context
    found = context._jvm.org.apache.spark.ml.classification
    array = context._gateway.new_array(found.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    model = RandomForestClassificationModel(found.RandomForestClassificationModel(
        parts[0].uid, array, parts[0].numFeatures, parts[0].numClasses))
    model._resetUid(parts[0].uid)
    est._copyValues(model)
    model._transfer_params_to_java()
    return model


@dataclass
class TrainResult:
    comparison: DataFrame                      # G10
    best_name: str | None
    best_path: str | None
    model_paths: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    prepared: Prepared | None = None
    run_ids: dict = field(default_factory=dict)


def save_artifacts(spark: SparkSession, root: str, prepared: Prepared) -> None:
    """Scaler moments and the feature order, next to the models."""
    prepared.scaler.to_frame(spark).write.mode("overwrite").parquet(f"{root}/scaler")
    spark.createDataFrame([(json.dumps(prepared.features),)], "features string") \
        .write.mode("overwrite").json(f"{root}/feature_columns")
    spark.createDataFrame([(json.dumps(prepared.split),)], "split string") \
        .write.mode("overwrite").json(f"{root}/split")


def load_split(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.json(f"{root}/split").first()["split"])


def load_artifacts(spark: SparkSession, root: str) -> tuple[ScalerModel, list[str]]:
    feats = json.loads(spark.read.json(f"{root}/feature_columns").first()["features"])
    scaler = ScalerModel.from_frame(spark.read.parquet(f"{root}/scaler"), feats)
    return scaler, feats


def train_all(processed: DataFrame, root: str, preset: str | Preset = "quick",
              runs_path: str | None = None, models: list[str] | None = None,
              scaler_fit: str = "train", split: str = "hash", side_by_side: bool = True) -> TrainResult:
    """Fit each model, time it, evaluate on the hold-out, log the run, keep the best F1.

    With ``side_by_side`` one thread a model fits on the one written training set, each in a
    scheduler pool of its own name (``spark.scheduler.mode`` FAIR shares the executors) and on its
    share of the cores, so no fit waits for the tasks of another; runs are logged in training order.
    Trees are grown inside tasks (``operators.trees``) if the training set's bins fit in one; in a larger set
    boosting is Spark ML's own and the forest is fitted in parts (``fit_forest``).
    Selection is strict ``>`` on F1 in training order (first wins a tie; an
    all-zero F1 keeps no model).  Run logging failures only warn, as before.
    """
    spark = processed.sparkSession
    p = PRESETS[preset] if isinstance(preset, str) else preset
    prep = prepare(processed, scaler_fit=scaler_fit, split=split)
    save_artifacts(spark, root, prep)
    train = prep.data.filter(F.col("is_test") == 0)
    test = prep.data.filter(F.col("is_test") == 1)
    names = models or list(p.models)

    def fit(name: str):
        if side_by_side:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        est = make_estimator(name, p, float(prep.n_train))
        t0 = time.time()
        beside = names if side_by_side else [name]
        path, model = f"{root}/models/{name}", None
        if name != "LogisticRegression" and fits(prep.n_train, len(prep.features)):
            (grow_forest if name == "RandomForest" else grow_boosted)(est, train, path)
        elif name == "RandomForest":
            model = fit_forest(est, train, lane_width(spark.sparkContext.defaultParallelism, name, beside))
        else:
            model = est.fit(own_lane(train, name, beside, prep.n_train) if len(beside) > 1 else train)
        fit_s = time.time() - t0
        # In its lane too: every task unpacks the whole model, and boosting would wait for it.
        held_out = own_lane(test, name, beside) if len(beside) > 1 else test
        metrics = evaluate_predictions(model.transform(held_out) if model else predicted(held_out, path))
        metrics["train_time_seconds"] = round(fit_s, 2)
        if model:
            model.write().overwrite().save(path)
        return metrics, path

    if side_by_side and len(names) > 1:
        with ThreadPoolExecutor(len(names)) as pool:
            # Each thread gets the caller's local properties, and its own from then on.
            fitted = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit), n) for n in names]]
    else:
        fitted = [fit(n) for n in names]
    rows, paths, all_metrics, run_ids = [], {}, {}, {}
    best_name, best_f1 = None, 0.0
    for order, (name, (metrics, path)) in enumerate(zip(names, fitted)):
        paths[name] = path
        all_metrics[name] = metrics
        if runs_path:
            try:
                run_ids[name] = R.log_run(spark, runs_path, name, model_params(name, p), metrics,
                                          tags={"framework": "spark-ml",
                                                "task": "binary_classification",
                                                "model_path": path})
            except Exception as e:  # noqa: BLE001 - tracking is best effort
                import logging
                logging.getLogger(__name__).warning("run logging failed: %s", e)
        if metrics["f1_score"] > best_f1:
            best_f1, best_name = metrics["f1_score"], name
        rows.append((order, name, metrics["accuracy"], metrics["precision"], metrics["recall"],
                     metrics["f1_score"], metrics["roc_auc"], metrics["train_time_seconds"]))
    comparison = spark.createDataFrame(
        rows, "train_order int, model string, accuracy double, precision double, recall double, "
              "f1_score double, roc_auc double, train_time_seconds double") \
        .withColumn("best", F.col("model") == F.lit(best_name))
    best_path = paths.get(best_name)
    if best_path:
        spark.createDataFrame([(best_name, best_path)], "model string, path string") \
            .write.mode("overwrite").json(f"{root}/best")
    return TrainResult(comparison, best_name, best_path, paths, all_metrics, prep, run_ids)


MODEL_CLASSES = {
    "LogisticRegression": LogisticRegressionModel,
    "RandomForest": RandomForestClassificationModel,
    "GradientBoosting": GBTClassificationModel,
    "XGBoost": GBTClassificationModel,
}


def load_model(name: str, path: str):
    return MODEL_CLASSES[name].load(path)


def load_best(spark: SparkSession, root: str):
    row = spark.read.json(f"{root}/best").first()
    return row["model"], load_model(row["model"], row["path"])


# --- H7: evaluate job --------------------------------------------------------------

def evaluate_job(processed: DataFrame, root: str, runs_path: str | None = None):
    """Reload model + scaler + feature order, re-derive the hold-out, full report.

    Returns (metrics dict, confusion DataFrame, class report DataFrame); logs an
    ``evaluation`` run whose metric names carry the ``eval_`` prefix.
    """
    spark = processed.sparkSession
    name, model = load_best(spark, root)
    scaler, feats = load_artifacts(spark, root)
    # The rows that training held out, by its own settings.
    test = processed.withColumn("is_test", split_flag(load_split(spark, root))).filter(F.col("is_test") == 1)
    x = VectorAssembler(inputCols=feats, outputCol="features").transform(
        test.select(F.col(K.TARGET).cast("double").alias("label"), *scaler.columns()))
    pred = positive_probability(model.transform(x))
    scored = pred.select(F.col("label").cast("int").alias("label"),
                         F.col("prediction").cast("int").alias("prediction"),
                         F.col("p").alias("score"))
    conf = confusion(scored)
    metrics = evaluate_predictions(pred, digits=None)
    report = class_report(conf)
    if runs_path:
        R.log_run(spark, runs_path, "evaluation", {}, {f"eval_{k}": v for k, v in metrics.items()},
                  tags={"stage": "evaluation"}, model_type=name)
    return metrics, conf, report
