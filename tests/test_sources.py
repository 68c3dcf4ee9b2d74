"""Scans and sinks: CSV round trip, SQL tables, log append by name, run store scan."""
import os

import pytest
from pyspark.sql import functions as F

from tarmac.functions import constants as K
from tarmac.plans import queries as Q
from tarmac.plans.runs import best_run, log_run, read_runs, scan_run_store
from tarmac.sources import files as S
from tarmac.sources import testdata as T


def test_csv_roundtrip_and_contract(spark, sf, tmp):
    raw = T.flights_raw(spark, sf, with_key=False)
    S.write_processed(raw, f"{tmp}/raw_csv", fmt="csv")
    back = S.read_raw_csv(spark, f"{tmp}/raw_csv")
    assert back.schema == S.RAW_SCHEMA
    assert back.count() == raw.count()
    assert back.exceptAll(raw).count() == 0
    contract = S.column_contract(back.drop("Distance"))
    missing = [r["column_name"] for r in contract.filter("NOT present").collect()]
    assert missing == ["Distance"]
    with pytest.raises(ValueError):
        S.column_contract(back.drop("Distance"), strict=True)
    with pytest.raises(Exception):
        S.read_raw_csv(spark, f"{tmp}/nope").count()


def test_load_table_and_declared(spark, sf, tmp):
    df = Q.processed(spark, sf, keep_key=False)
    n = S.load_table(df, "flights_t", path=f"{tmp}/flights_t")
    assert n == df.count()
    assert S.query(spark, "SELECT count(*) AS n FROM flights_t").first()["n"] == n
    assert S.training_data(spark, "flights_t").count() == n
    d = S.create_declared_table(spark, "flights_declared_t")
    S.create_declared_table(spark, "flights_declared_t")  # idempotent
    assert len(d.columns) == 23
    conformed = S.conform(df, d.schema)
    assert conformed.columns == d.columns


def test_log_append_by_name_and_csv_parse(spark, sf, tmp):
    log = T.prediction_log(spark, sf).drop("event_id")
    reordered = log.select(*reversed(log.columns))  # written by name, not position
    S.append_log(log, f"{tmp}/log")
    S.append_log(reordered, f"{tmp}/log")
    back = S.read_log(spark, f"{tmp}/log")
    assert back.drop("event_id").columns == K.LOG_COLUMNS
    assert back.count() == 2 * log.count()
    log.limit(5).write.option("header", True).csv(f"{tmp}/log_csv")
    parsed = S.read_log(spark, f"{tmp}/log_csv", fmt="csv")
    assert dict(parsed.dtypes)["timestamp"] == "timestamp"


def test_drift_report_sink(spark, sf, tmp):
    from tarmac.operators.drift import drift_report, ks_drift
    ref, prod = Q._drift_inputs(spark, sf)
    rep = drift_report(ks_drift(ref, prod), ref.count(), prod.count())
    S.write_drift_report(rep, f"{tmp}/report")
    back = spark.read.json(f"{tmp}/report").first()
    assert back["n_production"] == prod.count()


def test_runs_table_and_best(spark, tmp):
    path = f"{tmp}/runs"
    log_run(spark, path, "RandomForest", {"n": 1}, {"f1_score": 0.8912})
    log_run(spark, path, "LogisticRegression", {"n": 2}, {"f1_score": 0.8894})
    log_run(spark, path, "RandomForest", {"n": 3}, {"f1_score": 0.8912})
    log_run(spark, path, "evaluation", {}, {"eval_f1_score": 0.9})
    runs = read_runs(spark, path)
    b = best_run(runs).first()
    assert b["run_name"] == "RandomForest" and b["params"]["n"] == "1"
    assert b["tags"]["model_type"] == "RandomForest"
    assert best_run(runs.limit(0)).count() == 0


def test_run_store_scan(spark, tmp):
    run = "52511842ed1f47fa9444df43219860ee"
    base = os.path.join(tmp, "store", "1", run)
    os.makedirs(f"{base}/metrics")
    os.makedirs(f"{base}/params")
    os.makedirs(f"{base}/tags")
    with open(f"{base}/meta.yaml", "w") as f:
        f.write("run_name: RandomForest\nstart_time: 1772323200000\nend_time: 1772323214100\n")
    with open(f"{base}/metrics/f1_score", "w") as f:
        f.write("1772323214000 0.8900 0\n1772323214000 0.8912 0\n")
    with open(f"{base}/params/max_depth", "w") as f:
        f.write("15")
    with open(f"{base}/tags/model_type", "w") as f:
        f.write("RandomForest")
    row = scan_run_store(spark, os.path.join(tmp, "store")).first()
    assert row["run_id"] == run and row["run_name"] == "RandomForest"
    assert row["metrics"]["f1_score"] == pytest.approx(0.8912)
    assert row["params"]["max_depth"] == "15" and row["tags"]["model_type"] == "RandomForest"
    assert (row["end_time"] - row["start_time"]).total_seconds() == pytest.approx(14.1)


def test_csv_is_bound_by_name(spark, sf, tmp):
    raw = T.flights_raw(spark, sf, with_key=False)
    odd = raw.drop("AirTime").withColumn("TaxiOut", F.col("TaxiOut").cast("double"))
    odd = odd.withColumn("Distance", F.when(F.col("Month") == 1, F.lit("far")).otherwise(F.col("Distance").cast("string")))
    odd.select(*reversed(odd.columns)).withColumn("more", F.lit("x")).coalesce(1).write.option("header", True).csv(f"{tmp}/odd")
    back = S.read_raw_csv(spark, f"{tmp}/odd")
    assert "AirTime" not in back.columns and back.columns[-1] == "more"
    assert [r["column_name"] for r in S.column_contract(back).filter("not present").collect()] == ["AirTime"]
    same = [c for c in raw.columns if c not in ("AirTime", "Distance")]
    assert back.select(*same).exceptAll(raw.select(*same)).count() == 0
    failed = {r["column_name"]: r["failures"] for r in S.parse_failures(spark, f"{tmp}/odd").collect()}
    assert failed.pop("Distance") == raw.filter("Month = 1").count() and set(failed.values()) == {0}
    raw.select(*sorted(raw.columns)).coalesce(1).write.option("header", True).mode("append").csv(f"{tmp}/odd")
    with pytest.raises(Exception):
        S.read_raw_csv(spark, f"{tmp}/odd").collect()


@pytest.mark.parametrize("split", ["hash", "stratified"])
def test_csv_to_training_without_a_key(spark, sf, tmp, split):
    from tarmac.plans.etl import run_etl
    from tarmac.plans.training import evaluate_job, load_split, split_flag, train_all
    S.write_processed(T.flights_raw(spark, sf, with_key=False), f"{tmp}/csv", fmt="csv")
    run_etl(spark, f"{tmp}/processed", input_path=f"{tmp}/csv")
    processed = spark.read.parquet(f"{tmp}/processed")
    res = train_all(processed, f"{tmp}/models", models=["LogisticRegression"], split=split)
    flagged = processed.withColumn("is_test", split_flag(load_split(spark, f"{tmp}/models")))
    trained = res.prepared.data.filter("is_test = 0").select("flight_key")
    assert flagged.filter("is_test = 1").join(trained, "flight_key", "left_semi").count() == 0
    _metrics, conf, _report = evaluate_job(processed, f"{tmp}/models")
    assert conf.first()["n"] == res.prepared.n_test == flagged.filter("is_test = 1").count()


def test_log_keeps_every_append(spark, sf, tmp):
    from tarmac.operators.topk import history, recent
    log = T.prediction_log(spark, sf).drop("event_id").limit(30).cache()
    S.append_log(log, f"{tmp}/log")
    for _ in range(2):  # a replayed batch
        S.append_log(log.limit(7), f"{tmp}/log", run="stream-a", batch=0)
    S.append_log(log.limit(5), f"{tmp}/log", run="stream-b", batch=0)
    back = S.read_log(spark, f"{tmp}/log")
    assert back.count() == 30 + 7 + 5
    last = history(back, 5).drop("total", "event_id")
    assert last.exceptAll(log.limit(5)).count() == 0 and recent(back, 5).count() == 5


def test_run_store_is_written_by_tasks_and_read_at_its_depth(spark, sf, tmp, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Rows
    from tarmac.plans.service_queries import _write_run_store

    def none(*_):
        raise AssertionError("rows pass through the driver")

    monkeypatch.setattr(Rows, "toLocalIterator", none)
    suppliers = T.table(spark, sf, "supplier")
    root = os.path.join(tmp, "a5" * 16)  # a root that looks like a run
    _write_run_store(spark, suppliers, root)
    run = sorted(os.listdir(f"{root}/1"))[0]
    deep = f"{root}/1/{run}/artifacts/{'b7' * 16}"
    os.makedirs(f"{deep}/params")
    for name in ("meta.yaml", "params/nation"):
        with open(f"{deep}/{name}", "w") as f:
            f.write("run_name: an artifact")
    found = scan_run_store(spark, root)
    want = suppliers.selectExpr("md5(CAST(s_suppkey AS string))", "concat('run of ', s_name)", "CAST(s_nationkey AS string)",
                                "CAST(round(s_acctbal, 2) AS double)")
    got = found.select("run_id", "run_name", F.col("params")["nation"], F.col("metrics")["f1_score"])
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert scan_run_store(spark, f"{tmp}/no such store").count() == 0
