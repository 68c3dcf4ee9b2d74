"""Model jobs: quality floors, selection, persistence, scoring, attributions, streams."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tarmac.plans import queries as Q
from tarmac.plans.training import load_model


@pytest.fixture(scope="module")
def trained(spark, sf):
    return Q.trained(spark, sf)


def test_quality_above_baselines(spark, sf, trained):
    res, _root, _cats, proc = trained
    rate = proc.agg(F.avg("is_delayed")).first()[0]
    for name, m in res.metrics.items():
        assert m["roc_auc"] > 0.8, name
        assert m["f1_score"] > 2 * rate / (1 + rate), name   # beats "always delayed"
    cmp = res.comparison.collect()
    assert sum(r["best"] for r in cmp) == 1
    best = max(cmp, key=lambda r: (r["f1_score"], -r["train_order"]))
    assert best["model"] == res.best_name


def test_score_batch_and_stream_equal(spark, sf, trained):
    batch = Q.score_batch(spark, sf)
    stream = Q.stream_score(spark, sf)
    assert batch.count() == stream.count()
    assert batch.exceptAll(stream).count() == 0
    row = batch.first()
    assert row["prediction_label"] in ("DELAYED", "ON TIME")
    assert row["confidence"] >= 0.5


def test_linear_attributions_additive(spark, sf, trained):
    res, _root, _cats, _proc = trained
    a = Q.attributions_linear(spark, sf)
    err = a.select(F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)
                         - F.col("margin")).alias("e")).agg(F.max("e")).first()[0]
    assert err < 1e-9
    x, _feats = Q._assembled_requests(spark, sf)
    model = load_model("LogisticRegression", res.model_paths["LogisticRegression"])
    raw = model.transform(x).groupBy("request_id").agg(
        F.sum(vector_to_array("rawPrediction")[1]).alias("r"))
    got = a.groupBy("request_id").agg(F.sum("margin").alias("margin"))  # keys repeat
    j = got.join(raw, "request_id").select(F.abs(F.col("margin") - F.col("r")).alias("e"))
    assert j.agg(F.max("e")).first()[0] < 1e-9


def test_tree_attributions_additive(spark, sf, trained):
    from tarmac.operators.attributions import tree_attributions
    res, _root, _cats, _proc = trained
    x, feats = Q._assembled_requests(spark, sf)
    for kind, name, col in [("gbt", "GradientBoosting", "rawPrediction"),
                            ("forest", "RandomForest", "probability")]:
        a = tree_attributions(x, res.model_paths[name], len(feats), kind)
        m = load_model(name, res.model_paths[name])
        out = m.transform(x).select("request_id", vector_to_array(col)[1].alias("o"))
        # keys repeat, so compare per key after summing both sides
        got = a.groupBy("request_id").agg(F.sum("output").alias("a"))
        want = out.groupBy("request_id").agg(F.sum("o").alias("b"))
        e = got.join(want, "request_id").select(F.abs(F.col("a") - F.col("b")).alias("e"))
        assert e.agg(F.max("e")).first()[0] < 1e-9, name


def test_top_attributions_sorted(spark, sf, trained):
    row = Q.top_attributions(spark, sf).first()
    vals = [abs(p["value"]) for p in row["top"]]
    assert len(vals) == 15 and vals == sorted(vals, reverse=True)


def test_best_run_and_info(spark, sf, trained):
    res, _root, _cats, _proc = trained
    b = Q.best_run_q(spark, sf).first()
    assert b["metrics"]["f1_score"] == max(m["f1_score"] for m in res.metrics.values())
    info = Q.model_info_q(spark, sf).first()
    assert info["num_features"] == 24 and info["model_type"] == res.best_name
    imp = Q.importances_q(spark, sf).collect()
    assert len(imp) == 10 and imp[0]["importance"] >= imp[-1]["importance"]


def test_evaluate_and_log_stream(spark, sf, trained):
    rep = {r["class"]: r for r in Q.evaluate_model(spark, sf).collect()}
    assert rep["accuracy"]["support"] == rep["On-Time"]["support"] + rep["Delayed"]["support"]
    s = Q.stream_log(spark, sf).first()
    assert s["total_predictions"] > 0 and s["quarantined"] > 0
