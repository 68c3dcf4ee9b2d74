"""The saved scoring pipeline, the one-run ETL job, fits side by side, raw requests as a stream."""
import os
import subprocess
import sys

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tarmac.operators.requests import split_valid
from tarmac.plans import queries as Q
from tarmac.plans.etl import run_etl
from tarmac.plans.pipeline_model import scoring_pipeline
from tarmac.plans.scoring import score_requests
from tarmac.plans.training import load_artifacts, load_best, train_all
from tarmac.sources import testdata as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OTHER_SESSION = """
import sys
sys.path.insert(0, {root!r})
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from tarmac.session import build_session
spark = build_session("local[2]", app="another session", shuffle_partitions=2)
scored = PipelineModel.load({path!r}).transform(spark.read.parquet({requests!r}))
scored.select("request_id", "prediction", vector_to_array("probability")[1].alias("p")).write.parquet({out!r})
"""


@pytest.mark.parametrize("mode", ["fitted", "serving_compat"])
def test_pipeline_gives_equal_scores_in_another_session(spark, sf, tmp, mode):
    _res, root, cats, _proc = Q.trained(spark, sf)
    name, model = load_best(spark, root)
    scaler, feats = load_artifacts(spark, root)
    requests = T.score_requests(spark, sf)
    valid, _ = split_valid(requests)
    valid.write.parquet(f"{tmp}/requests")
    scoring_pipeline(cats if mode == "fitted" else None, scaler, model, mode).save(f"{tmp}/pipeline")
    job, _ = score_requests(requests, model, name, scaler, feats, cats, mode)
    want = job.select("request_id", F.col("is_delayed").cast("double").alias("prediction"), F.col("probability").alias("p"))
    here = PipelineModel.load(f"{tmp}/pipeline").transform(valid).select("request_id", "prediction", vector_to_array("probability")[1].alias("p"))
    assert here.count() == want.count() and here.exceptAll(want).count() == 0
    if mode == "fitted":
        code = OTHER_SESSION.format(root=ROOT, path=f"{tmp}/pipeline", requests=f"{tmp}/requests", out=f"{tmp}/there")
        subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True, cwd=tmp)
        assert spark.read.parquet(f"{tmp}/there").exceptAll(want).count() == 0


def test_etl_runs_its_input_once(spark, sf, tmp):
    raw = T.flights_raw(spark, sf)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    summary = run_etl(spark, f"{tmp}/out", raw=raw.mapInArrow(count, raw.schema))
    assert summary["rows_in"] == raw.count() == seen.value
    written = spark.read.parquet(f"{tmp}/out")
    assert summary["rows_out"] == written.count() and summary["columns"] == len(written.columns)
    assert summary["delay_rate"] == pytest.approx(written.agg(F.avg("is_delayed")).first()[0])


def test_fits_side_by_side_give_the_same_models(spark, sf, tmp):
    proc = Q.processed(spark, sf)
    one = train_all(proc, f"{tmp}/one", "quick", side_by_side=False)
    two = train_all(proc, f"{tmp}/two", "quick", side_by_side=True)
    drop = lambda m: {n: {k: v for k, v in x.items() if k != "train_time_seconds"} for n, x in m.items()}
    assert drop(one.metrics) == drop(two.metrics) and one.best_name == two.best_name
    assert [r.model for r in two.comparison.orderBy("train_order").collect()] == list(two.metrics)


def test_model_of_a_failed_fit_is_reported(spark, sf, tmp):
    with pytest.raises(ValueError):
        train_all(Q.processed(spark, sf), f"{tmp}/x", "quick", models=["LogisticRegression", "no such model"])


def test_raw_stream_equals_batch(spark, sf):
    from tarmac.plans import service_queries as V
    assert sorted(V.raw_requests(spark, sf).collect()) == sorted(V.raw_requests_stream(spark, sf).collect())


def test_declared_table_takes_rows_by_name(spark, sf):
    from tarmac.sources.files import DECLARED_SCHEMA, fill_declared_table
    rows = Q.processed(spark, sf, keep_key=False).limit(20)
    mixed = rows.select(*reversed(rows.columns)).drop("ArrDelay").withColumn("more", F.lit(1))
    spark.sql("DROP TABLE IF EXISTS declared_mixed")
    assert fill_declared_table(mixed, "declared_mixed") == fill_declared_table(mixed, "declared_mixed") == 20
    back = spark.table("declared_mixed")
    assert back.columns == DECLARED_SCHEMA.fieldNames() and back.filter("ArrDelay IS NOT NULL").count() == 0
    assert back.agg(F.sum("Distance")).first()[0] == mixed.agg(F.sum("Distance")).first()[0]
