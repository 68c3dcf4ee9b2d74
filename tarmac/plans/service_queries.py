"""Registered queries of the serving side: explanations, kept drift counts, committed log parts,
raw requests, the saved scoring pipeline, the declared table and the run store.

Stand-in inputs only give rows in the schema a job expects (``FIXTURES.md``).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tarmac import oracle as O
from tarmac.catalog import register
from tarmac.functions import constants as K
from tarmac.plans import queries as Q
from tarmac.session import shared_path
from tarmac.sources import testdata as T

# --- explanations (H10, G4) -----------------------------------------------------------------

def _shapley(spark, sf, name: str, kind: str):
    from tarmac.operators.shapley import tree_shapley
    res, _root, _cats, _proc = Q.trained(spark, sf)
    x, feats = Q._assembled_requests(spark, sf)
    return tree_shapley(x, res.model_paths[name], len(feats), kind), x, res


def _gap():
    """How far base and contributions are from the output."""
    return F.max(F.abs(F.aggregate("contributions", F.col("base"), lambda a, v: a + v) - F.col("output")))


@register("shapley_boosted", Q.req_sql("""
SELECT count(*) FILTER (WHERE reasons = '') AS explained, true AS additive, true AS equals_model FROM chk"""))
def shapley_boosted(spark, sf):
    """Exact Shapley values of the boosted model for every valid request; base and
    contributions add up to the model's own margin."""
    from tarmac.plans.training import load_model
    values, x, res = _shapley(spark, sf, "GradientBoosting", "gbt")
    model = load_model("GradientBoosting", res.model_paths["GradientBoosting"])
    margin = model.transform(x).groupBy("request_id").agg(F.sum(vector_to_array("rawPrediction")[1]).alias("margin"))
    # Keys may repeat: both sides are summed by key.
    by_key = values.groupBy("request_id").agg(F.sum("output").alias("total"), F.count(F.lit(1)).alias("n"), _gap().alias("gap"))
    return by_key.join(margin, "request_id").agg(
        F.sum("n").alias("explained"), (F.max("gap") < 1e-9).alias("additive"),
        (F.max(F.abs(F.col("total") - F.col("margin"))) < 1e-6).alias("equals_model"))


@register("shapley_top")
def shapley_top(spark, sf):
    """H10 + G7: the 15 largest Shapley values of every valid request (boosted model)."""
    from tarmac.operators.topk import top_k_by_abs
    values, _x, _res = _shapley(spark, sf, "GradientBoosting", "gbt")
    _, feats = Q._assembled_requests(spark, sf)
    return values.select("request_id", top_k_by_abs("contributions", feats, 15).alias("top"))


@register("shapley_any_model", """
SELECT 3 AS explained, true AS equals_linear, true AS additive""")
def shapley_any_model(spark, sf):
    """H10 without a model's own form: the three longest delays of the requests (a top-k report)
    explained through 50 background rows; for a linear model's margin that is exact."""
    from tarmac.operators.shapley import kernel_shapley
    from tarmac.plans.training import load_model
    res, _root, _cats, _proc = Q.trained(spark, sf)
    model = load_model("LogisticRegression", res.model_paths["LogisticRegression"])
    x, feats = Q._assembled_requests(spark, sf)
    top = x.select("request_id", "features", vector_to_array("features")[feats.index("DepDelay")].alias("d")) \
        .orderBy(F.desc("d"), "request_id").limit(3)
    train = res.prepared.data.filter(F.col("is_test") == 0)
    background = train.orderBy(F.md5("flight_key"), "flight_key").limit(50).select("features")
    mean = list(background.agg(*[F.avg(vector_to_array("features")[i]) for i in range(len(feats))]).first())
    found = kernel_shapley(top, lambda df: model.transform(df).withColumn("score", vector_to_array("rawPrediction")[1]), background)
    want = F.array(*[F.lit(float(c)) * (vector_to_array("features")[i] - F.lit(float(m)))
                     for i, (c, m) in enumerate(zip(model.coefficients.toArray().tolist(), mean))])
    gaps = F.array_max(F.zip_with("contributions", "want", lambda a, b: F.abs(a - b)))
    return found.join(top.select("request_id", want.alias("want")), "request_id").agg(
        F.count(F.lit(1)).cast("int").alias("explained"), (F.max(gaps) < 1e-6).alias("equals_linear"), (_gap() < 1e-9).alias("additive"))


# --- committed parts and kept counts (A10, J1, J5) ------------------------------------------

def _append_in_thirds(spark, log, path: str, after=lambda: None) -> None:
    from tarmac.sources.files import append_log
    edges = log.agg(F.percentile_approx("event_id", [1 / 3, 2 / 3])).first()[0]
    low, high = edges
    for n, part in enumerate((log.filter(F.col("event_id") <= low), log.filter((F.col("event_id") > low) & (F.col("event_id") <= high)),
                              log.filter(F.col("event_id") > high))):
        append_log(part, path, run="log", batch=n)
        after()


@register("log_committed", Q.plog_sql("""
SELECT count(*) AS rows, 3 AS parts, sum(event_id % 2) >= 0 AS complete, CAST(sum(distance) AS BIGINT) AS sum_distance FROM plog"""))
def log_committed(spark, sf):
    """A10: three appends, one of them written by a job that died before its commit and written
    again, all three replayed: every row is there once."""
    from tarmac.sources.files import append_log, read_log
    path = shared_path(spark, "log-committed", unique=True)
    log = T.prediction_log(spark, sf)
    # What a job that died leaves behind: files of an attempt without a commit.
    log.drop("event_id").write.parquet(f"{path}/parts/run=log/batch=1/attempt=died")
    _append_in_thirds(spark, log, path)
    _append_in_thirds(spark, log, path)
    return read_log(spark, path).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id.run", "event_id.batch").cast("int").alias("parts"),
        (F.count_if(F.col("event_id").isNull()) == 0).alias("complete"), F.sum("distance").alias("sum_distance"))


@register("ks_drift_kept", Q._drift_sql())
def ks_drift_kept(spark, sf):
    """J1-J3 from kept counts: the training table is counted once, the log part by part."""
    from tarmac.plans.drift_state import count_new_parts, drift_of_state, keep_reference
    base = shared_path(spark, "drift-state", unique=True)
    keep_reference(Q.cleaned(spark, sf), f"{base}/state")
    _append_in_thirds(spark, T.prediction_log(spark, sf), f"{base}/log",
                      after=lambda: count_new_parts(spark, f"{base}/state", f"{base}/log"))
    return drift_of_state(spark, f"{base}/state")


# --- raw requests (B11, K1) -----------------------------------------------------------------

def _request_lines(spark, sf):
    """Every request as a JSON line; those of some orders are damaged (``FIXTURES.md``)."""
    requests = T.score_requests(spark, sf)
    rows = requests.select("request_id", F.to_json(F.struct(*requests.columns)).alias("body"))
    fault = F.split("request_id", "-")[0].cast("long") % 12
    changes = [(r'"month":\d+', '"month":"July"'), (r'"distance":-?\d+,', ''), (r'"dep_hour":(\d+)', '"dep_hour":$1.5'),
               (r'"carrier":"[^"]*"', '"carrier":7'), (r'"day_of_week":(\d+)', '"day_of_week":"$1"'),
               (r'"dep_minute":\d+', '"dep_minute":null'), (r'"dep_delay":-?[0-9.]+', '"dep_delay":"late"')]
    line = F.when(fault == 1, F.expr("left(body, length(body) - 5)"))
    for n, (found, put) in enumerate(changes, 2):
        line = line.when(fault == n, F.regexp_replace("body", found, put))
    return rows.select(line.otherwise(F.col("body")).alias("value"))


_RAW_REASONS = Q.req_sql("""
, f AS (SELECT *, CAST(split_part(request_id, '-', 1) AS BIGINT) % 12 AS fault FROM chk)
, d AS (SELECT CASE fault
    WHEN 1 THEN 'body:malformed'
    WHEN 2 THEN concat_ws(',', 'month:type', nullif(reasons, ''))
    WHEN 3 THEN concat_ws(',', nullif(list_aggregate(list_filter(string_split(reasons, ','), lambda x: x LIKE '%missing'), 'string_agg', ','), ''),
      'distance:missing', nullif(list_aggregate(list_filter(string_split(reasons, ','), lambda x: x LIKE '%range' AND x <> 'distance:range'), 'string_agg', ','), ''))
    WHEN 4 THEN concat_ws(',', 'dep_hour:type', nullif(reasons, ''))
    WHEN 5 THEN concat_ws(',', 'carrier:type', nullif(reasons, ''))
    WHEN 7 THEN concat_ws(',', 'dep_minute:type', nullif(reasons, ''))
    WHEN 8 THEN concat_ws(',', 'dep_delay:type', nullif(reasons, ''))
    ELSE reasons END AS reasons FROM f)
SELECT reasons, count(*) AS requests FROM d GROUP BY reasons""")


def _reason_counts(good, bad):
    return good.select(F.lit("").alias("reasons")).union(bad.select("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("requests"))


@register("raw_requests", _RAW_REASONS)
def raw_requests(spark, sf):
    """JSON lines read, typed and split; how many requests have which reasons."""
    from tarmac.operators.requests import split_valid
    from tarmac.sources.raw_requests import read_requests
    path = shared_path(spark, "request-lines", unique=True)
    _request_lines(spark, sf).write.text(path)
    return _reason_counts(*split_valid(read_requests(spark, path)))


@register("raw_requests_stream", _RAW_REASONS)
def raw_requests_stream(spark, sf):
    """K1 on JSON lines: scored rows in the sink, rejected ones with reasons in quarantine."""
    from tarmac.streaming.scoring import run_scoring_stream
    _res, root, cats, _proc = Q.trained(spark, sf)
    base = shared_path(spark, "raw-stream", unique=True)
    _request_lines(spark, sf).write.text(f"{base}/lines")
    for handle in run_scoring_stream(spark, f"{base}/lines", f"{base}/scored", f"{base}/ckpt", root, cats,
                                     quarantine_folder=f"{base}/quarantine", fmt="json"):
        handle.awaitTermination()
    return _reason_counts(spark.read.parquet(f"{base}/scored"), spark.read.parquet(f"{base}/quarantine"))


# --- one saved pipeline (A13) ---------------------------------------------------------------

@register("pipeline_scores", Q.req_sql("""
SELECT count(*) FILTER (WHERE reasons = '') AS scored, 0 AS different FROM chk"""))
def pipeline_scores(spark, sf):
    """The scoring steps, with the boosted model, saved as one PipelineModel and loaded again
    give the scores of the scoring job."""
    from pyspark.ml import PipelineModel
    from tarmac.operators.requests import split_valid
    from tarmac.plans.pipeline_model import scoring_pipeline
    from tarmac.plans.scoring import score_requests
    from tarmac.plans.training import load_artifacts, load_model
    res, root, cats, _proc = Q.trained(spark, sf)
    name = "GradientBoosting"
    model = load_model(name, res.model_paths[name])
    scaler, feats = load_artifacts(spark, root)
    path = shared_path(spark, "scoring-pipeline", unique=True)
    scoring_pipeline(cats, scaler, model).save(path)
    requests = T.score_requests(spark, sf)
    valid, _rejected = split_valid(requests)
    mine = PipelineModel.load(path).transform(valid).select("request_id", vector_to_array("probability")[1].alias("p"))
    job, _rejected = score_requests(requests, model, name, scaler, feats, cats)
    both = mine.select("request_id", F.lit(1).alias("a"), F.lit(0).alias("b"), "p") \
        .union(job.select("request_id", F.lit(0), F.lit(1), "probability"))
    # Keys may repeat: equal scores on both sides of every key and score.
    return both.groupBy("request_id", "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(
        F.sum("a").alias("scored"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("different"))


# --- tables and runs (A6, A12, A15, B8, B13, H5) --------------------------------------------

@register("declared_table", Q._declared_sql())
def declared_table(spark, sf):
    """The declared table made by DDL and filled by name, twice; what it holds."""
    from tarmac.sources.files import fill_declared_table
    name = "declared_" + T.short_id(sf)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = shared_path(spark, "declared", unique=True)
    rows = Q.processed(spark, sf, keep_key=False)
    if fill_declared_table(rows, name, path) != fill_declared_table(rows, name, path):
        raise AssertionError("a second run changed the declared table")
    return spark.table(name).withColumn("log_distance", F.round("log_distance", 9))


@register("run_store", """
SELECT md5(CAST(s_suppkey AS VARCHAR)) AS run_id, 'run of ' || s_name AS run_name, CAST(s_nationkey AS VARCHAR) AS nation,
  round(s_acctbal, 2) AS f1_score, CAST(epoch_ms(1772323200000 + s_suppkey * 1000) AS VARCHAR) AS started FROM supplier""")
def run_store(spark, sf):
    """A tracking folder of one-value files (a run for each supplier) scanned into run rows."""
    from tarmac.plans.runs import scan_run_store
    root = shared_path(spark, "run-store", unique=True)
    _write_run_store(spark, T.table(spark, sf, "supplier"), root)
    runs = scan_run_store(spark, root)
    return runs.select("run_id", "run_name", F.col("params")["nation"].alias("nation"),
                       F.round(F.col("metrics")["f1_score"], 2).alias("f1_score"), F.col("start_time").cast("string").alias("started"))


def _write_run_store(spark, suppliers, root: str) -> None:
    """The stand-in store: the layout needs a file for each value, so each task writes those of its runs."""
    rows = suppliers.select(F.md5(F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey", "s_name", "s_nationkey",
                            F.round("s_acctbal", 2).cast("string").alias("balance"))

    def write(runs):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)

        def put(name: str, text: str) -> None:
            with store.open_output_stream(f"{base}/1/{name}") as out:
                out.write(text.encode())

        for r in runs:
            start = 1772323200000 + r["s_suppkey"] * 1000
            for kind in ("metrics", "params", "tags"):
                store.create_dir(f"{base}/1/{r['id']}/{kind}")
            put(f"{r['id']}/meta.yaml", f"run_name: run of {r['s_name']}\nstart_time: {start}\nend_time: {start + 60000}\n")
            put(f"{r['id']}/metrics/f1_score", f"{start} 0.5 0\n{start + 1} {r['balance']} 1\n")
            put(f"{r['id']}/params/nation", str(r["s_nationkey"]))
            put(f"{r['id']}/tags/model_type", "RandomForest")

    rows.repartition(spark.sparkContext.defaultParallelism).foreachPartition(write)


@register("drift_report_file", Q._drift_sql().replace("SELECT feature, p < ", ", res AS (SELECT feature, p < ", 1) + """)
SELECT feature, drift, p_value, ks_statistic, ref_mean, prod_mean, ref_std, prod_std FROM res""")
def drift_report_file(spark, sf):
    """The nested drift report written as JSON and read back, a row for each feature."""
    from tarmac.operators.drift import drift_report, ks_drift
    from tarmac.sources.files import write_drift_report
    ref, prod = Q._drift_inputs(spark, sf)
    path = shared_path(spark, "drift-report", unique=True)
    write_drift_report(drift_report(ks_drift(ref, prod), ref.count(), prod.count()), path)
    value = "struct<drift:boolean,p_value:double,ks_statistic:double,ref_mean:double,prod_mean:double,ref_std:double,prod_std:double>"
    back = spark.read.schema(f"features map<string,{value}>").json(path)
    return back.select(F.explode("features").alias("feature", "v")).select("feature", "v.*")


@register("aligned_columns", O.flights_sql("""
SELECT Reporting_Airline, CAST(sum(time_of_day_morning) AS BIGINT) AS morning, CAST(sum(season_winter) AS BIGINT) AS winter,
  CAST(sum(distance_group_long) AS BIGINT) AS long_way, CAST(0 AS BIGINT) AS of_no_column, count(*) AS flights
FROM pf GROUP BY Reporting_Airline""", processed=True))
def aligned_columns(spark, sf):
    """B8 + B13: one-hot columns chosen by prefix, aligned to an order with a column that is absent."""
    from tarmac.plans.features import align, prefixed_columns
    proc = Q.processed(spark, sf)
    order = [*prefixed_columns(proc), "season_monsoon"]
    aligned = align(proc, order, keep=["Reporting_Airline"])
    return aligned.groupBy("Reporting_Airline").agg(
        F.sum("time_of_day_morning").alias("morning"), F.sum("season_winter").alias("winter"),
        F.sum("distance_group_long").alias("long_way"), F.sum("season_monsoon").cast("long").alias("of_no_column"),
        F.count(F.lit(1)).alias("flights"))


@register("weekday_names", O.flights_sql(f"""
SELECT DayOfWeek, {K.WEEKDAY_NAMES}[DayOfWeek] AS weekday, count(*) AS flights FROM cf GROUP BY ALL"""))
def weekday_names(spark, sf):
    """Weekday names."""
    from tarmac.functions import columns as X
    return Q.cleaned(spark, sf).groupBy("DayOfWeek", X.weekday_name("DayOfWeek").alias("weekday")).agg(F.count(F.lit(1)).alias("flights"))


@register("alternative_booster")
def alternative_booster(spark, sf):
    """H5: the alternative booster fitted, evaluated and compared with the linear model."""
    from tarmac.plans.training import train_all
    _res, _root, _cats, proc = Q.trained(spark, sf)
    res = train_all(proc, shared_path(spark, "models", unique=True), Q.MODEL_PRESET, models=["LogisticRegression", "XGBoost"])
    return res.comparison.drop("train_time_seconds")


@register("contract_counts", O.flights_sql("SELECT column_name, present, n AS values_read FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {str(c != 'AirTime').lower()} AS present, "
    + (f"count({c})" if c != "AirTime" else "0 * count(*)") + " AS n FROM flights_raw" for c in K.RAW_COLUMNS) + ")"))
def contract_counts(spark, sf):
    """A2 with the rows: expected columns of a CSV, whether each is there, and its values read."""
    from tarmac.sources.files import column_contract, read_raw_csv
    raw = read_raw_csv(spark, Q._csv_of_flights(spark, sf))
    there = [c for c in K.RAW_COLUMNS if c in raw.columns]
    counts = raw.agg(*[F.count(c).alias(c) for c in there])
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in there])).alias("v"))
    return column_contract(raw).join(counts.select("v.*"), "column_name", "left").select(
        "column_name", "present", F.coalesce("n", F.lit(0)).alias("values_read"))


# --- model jobs against DuckDB (H6, H7, H8, H10, K1, K2, G5, G8, G9) ------------------------

#: A linear model with declared coefficients: its scores have a SQL form.
DECLARED = {"DepDelay": 0.05, "dep_delay_flag": 0.7, "dep_hour": 0.02, "is_weekend": 0.1, "log_distance": 0.08, "season_winter": 0.2,
            "origin_freq": 3.0, "carrier_encoded": -0.01}
DECLARED_INTERCEPT = -2.0
_MARGIN = f"({DECLARED_INTERCEPT}e0 + " + " + ".join(f"{w}e0 * {c}" for c, w in DECLARED.items()) + ")"


def _declared_model(spark):
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.linalg import Vectors
    from tarmac.plans.features import FEATURES
    from pyspark.ml.common import _py2java
    weights = _py2java(spark.sparkContext, Vectors.dense([DECLARED.get(c, 0.0) for c in FEATURES]))
    return LogisticRegressionModel(spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "declared", weights, DECLARED_INTERCEPT))


def _no_scaling():
    from tarmac.operators.encoders import ScalerModel
    from tarmac.plans.features import FEATURES
    return ScalerModel(list(FEATURES), [0.0] * len(FEATURES), [1.0] * len(FEATURES))


def _exact_features_sql(body: str) -> str:
    """Request features without the rounding of ``request_features``."""
    return Q._request_features_sql().replace("round(ln(1 + distance), 9)", "ln(1 + distance)").replace(
        "SELECT request_id, month AS Month", ", rf AS (SELECT request_id, month AS Month", 1) + ")" + body


_DECLARED_SQL = _exact_features_sql(f"""
, p AS (SELECT request_id, 1e0 / (1e0 + exp(-{_MARGIN})) AS p FROM rf)
SELECT request_id, CASE WHEN p > 0.5 THEN '{K.DELAYED_LABEL}' ELSE '{K.ON_TIME_LABEL}' END AS prediction_label,
  round(p, 4) AS delay_probability, CAST(p > 0.5 AS INT) AS is_delayed, round(greatest(p, 1 - p), 4) AS confidence FROM p""")
_DECLARED_COLUMNS = ["request_id", "prediction_label", "delay_probability", "is_delayed", "confidence"]


@register("score_declared", _DECLARED_SQL)
def score_declared(spark, sf):
    """H8: the scoring job with a linear model of declared coefficients."""
    from tarmac.plans.features import FEATURES
    from tarmac.plans.scoring import score_requests
    scored, _ = score_requests(T.score_requests(spark, sf), _declared_model(spark), "LogisticRegression", _no_scaling(),
                               list(FEATURES), Q.category_model(spark, sf))
    return scored.select(*_DECLARED_COLUMNS)


@register("stream_score_declared", _DECLARED_SQL)
def stream_score_declared(spark, sf):
    """K1: the scoring stream with the same declared model, saved and loaded."""
    from tarmac.plans.features import FEATURES
    from tarmac.plans.training import Prepared, save_artifacts
    from tarmac.streaming.scoring import run_scoring_stream
    root = shared_path(spark, "declared-model", unique=True)
    _declared_model(spark).save(f"{root}/model")
    save_artifacts(spark, root, Prepared(None, list(FEATURES), _no_scaling(), {}, 0, 0))
    spark.createDataFrame([("LogisticRegression", f"{root}/model")], "model string, path string").write.json(f"{root}/best")
    base = Q._stage_requests(spark, sf)
    run_scoring_stream(spark, f"{base}/requests", f"{base}/scored", f"{base}/ckpt", root, Q.category_model(spark, sf)).awaitTermination()
    return spark.read.parquet(f"{base}/scored").select(*_DECLARED_COLUMNS)


@register("attributions_declared", _exact_features_sql(f"""
SELECT request_id, {DECLARED_INTERCEPT}e0 AS base, round({_MARGIN}, 9) AS margin, round(0.05e0 * DepDelay, 9) AS of_delay FROM rf"""))
def attributions_declared(spark, sf):
    """H10 (linear): base, margin and one contribution of the declared model."""
    from pyspark.ml.feature import VectorAssembler
    from tarmac.operators.attributions import linear_attributions
    from tarmac.operators.requests import split_valid
    from tarmac.plans.features import FEATURES, serving_features
    valid, _ = split_valid(T.score_requests(spark, sf))
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        serving_features(valid, "fitted", Q.category_model(spark, sf)))
    found = linear_attributions(x, _declared_model(spark))
    return found.select("request_id", "base", F.round("margin", 9).alias("margin"),
                        F.round(F.col("contributions")[list(FEATURES).index("DepDelay")], 9).alias("of_delay"))


_HELD = f"SELECT * FROM (SELECT is_delayed, {Q._HASH_SQL} AS is_test FROM cf) WHERE is_test = 1"


@register("evaluate_supports", O.flights_sql(f"""
, t AS ({_HELD}), n AS (SELECT count(*) FILTER (WHERE is_delayed = 0) AS n0, count(*) FILTER (WHERE is_delayed = 1) AS n1 FROM t)
SELECT 'On-Time' AS class, n0 AS support FROM n UNION ALL SELECT 'Delayed', n1 FROM n
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), n0 + n1 FROM n"""))
def evaluate_supports(spark, sf):
    """H7: the evaluation job judges the very rows that training held out."""
    return Q.evaluate_model(spark, sf).select("class", "support")


@register("train_rows", O.flights_sql(f"""
SELECT count(*) FILTER (WHERE is_test = 0) AS train, count(*) FILTER (WHERE is_test = 1) AS held_out,
  3 AS models, 1 AS best, true AS better_than_always
FROM (SELECT is_delayed, {Q._HASH_SQL} AS is_test FROM cf)"""))
def train_rows(spark, sf):
    """Rows of the fits, one best of three models, each better than "always delayed"."""
    res, _root, _cats, _proc = Q.trained(spark, sf)
    rate = F.lit(res.prepared.data.filter("is_test = 1").agg(F.avg("label")).first()[0])
    return res.comparison.agg(
        F.lit(res.prepared.n_train).cast("long").alias("train"), F.lit(res.prepared.n_test).cast("long").alias("held_out"),
        F.count(F.lit(1)).cast("int").alias("models"), F.count_if("best").cast("int").alias("best"),
        F.bool_and(F.col("f1_score") > 2 * rate / (1 + rate)).alias("better_than_always"))


@register("stream_log_counts", Q.req_sql("""
SELECT count(*) FILTER (WHERE reasons = '') AS total_predictions, count(*) FILTER (WHERE reasons <> '') AS quarantined FROM chk"""))
def stream_log_counts(spark, sf):
    """K2: how many rows the log stream appended and quarantined."""
    return Q.stream_log(spark, sf).select("total_predictions", "quarantined")


@register("importance_shares", O.flights_sql("SELECT 24 AS features, true AS add_up, count(*) > 0 AS trained FROM cf"))
def importance_shares(spark, sf):
    """The forest's importances are shares of one over all features of the table."""
    from tarmac.plans.scoring import importances
    model, feats = Q._forest(spark, sf)
    return importances(spark, model, feats).agg(
        F.count(F.lit(1)).cast("int").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("add_up"),
        (F.max("importance") > 0).alias("trained"))


@register("best_of_runs", """
SELECT md5(CAST(s_suppkey AS VARCHAR)) AS run_id, 'run of ' || s_name AS run_name FROM supplier
ORDER BY round(s_acctbal, 2) DESC NULLS LAST, s_suppkey, run_id LIMIT 1""")
def best_of_runs(spark, sf):
    """A14 + G8: run rows appended in two parts, the best by F1 (ties: earliest start)."""
    from tarmac.plans.runs import RUNS_SCHEMA, best_run, read_runs
    path = shared_path(spark, "runs", unique=True)
    start = F.timestamp_millis(F.lit(1772323200000) + F.col("s_suppkey") * 1000)
    text = F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"))
    rows = T.table(spark, sf, "supplier").select(
        F.md5(F.col("s_suppkey").cast("string")).alias("run_id"), F.concat(F.lit("run of "), "s_name").alias("run_name"),
        start.alias("start_time"), start.alias("end_time"), text.alias("params"),
        F.create_map(F.lit("f1_score"), F.round("s_acctbal", 2).cast("double")).alias("metrics"), text.alias("tags"))
    for odd in (0, 1):
        rows.filter(F.pmod(F.crc32(F.col("run_id").cast("binary")), F.lit(2)) == odd).write.mode("append").parquet(path)
    return best_run(read_runs(spark, path)).select("run_id", "run_name")
