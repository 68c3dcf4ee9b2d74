"""Invariants from the test strategy: shares, scaling, metrics, split, KS, prefix sums."""
import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import aggregates as A
from tarmac.operators.cumulative import exclusive_prefix
from tarmac.operators.drift import drift_report, gated_drift, ks_drift
from tarmac.operators.encoders import CategoryModel, ScalerModel, ordinal_codes
from tarmac.operators.metrics import confusion, roc_auc
from tarmac.plans import queries as Q
from tarmac.plans.features import FEATURES, ONE_HOT_COLUMNS, PROCESSED_COLUMNS
from tarmac.plans.training import hash_split_flag
from tarmac.sources import testdata as T


def test_shares_sum_to_one(spark, sf):
    m = CategoryModel.fit(Q.cleaned(spark, sf))
    sums = {r["kind"]: r["s"] for r in m.table.groupBy("kind").agg(F.sum("share").alias("s")).collect()}
    assert sums["origin"] == pytest.approx(1.0) and sums["dest"] == pytest.approx(1.0)
    codes = sorted(r["code"] for r in m.table.filter("kind = 'carrier'").collect())
    assert codes == list(range(len(codes)))


def test_one_hots_at_most_one_per_group(spark, sf):
    df = Q.processed(spark, sf)
    groups = [[c for c in ONE_HOT_COLUMNS if c.startswith(p)] for p in
              ("time_of_day_", "season_", "distance_group_")]
    bad = df.filter(F.greatest(*[sum(F.col(c) for c in g) for g in groups]) > 1).count()
    assert bad == 0
    assert df.columns[1:] == PROCESSED_COLUMNS


def test_scaled_mean_zero_std_one(spark, sf):
    df = Q.processed(spark, sf, keep_key=False)
    m = ScalerModel.fit(df, FEATURES)
    scaled = m.transform(df, keep=[])
    row = scaled.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    for c, s in zip(FEATURES, m.stds):
        assert row[f"m_{c}"] == pytest.approx(0.0, abs=1e-9)
        assert row[f"s_{c}"] == pytest.approx(1.0 if s > 0 else 0.0, abs=1e-9)


def test_confusion_cells_sum_to_n(spark, sf):
    s = T.scored(spark, sf).withColumn("prediction", (F.col("score") >= 50).cast("int"))
    c = confusion(s).first()
    assert c["tn"] + c["fp"] + c["fn"] + c["tp"] == s.count() == c["n"]


def test_auc_symmetry_and_brute_force(spark, sf):
    s = T.scored(spark, sf)
    a = roc_auc(s).first()["roc_auc"]
    b = roc_auc(s.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert a + b == pytest.approx(1.0)
    rows = [(r["label"], r["score"]) for r in s.collect()]
    pos = [x for y, x in rows if y == 1]
    neg = [x for y, x in rows if y == 0]
    import bisect
    neg_sorted = sorted(neg)
    u = sum(bisect.bisect_left(neg_sorted, p) + 0.5 * (bisect.bisect_right(neg_sorted, p)
                                                       - bisect.bisect_left(neg_sorted, p))
            for p in pos)
    assert a == pytest.approx(u / (len(pos) * len(neg)), abs=1e-12)


def test_prefix_sum_equals_global_window(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).cast("double").alias("v"),
                                     (F.col("id") % 5).alias("w"), (F.col("id") % 3).alias("g"))
    df = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = exclusive_prefix(df, "v", ["w"], groups=["g"], buckets=16)
    win = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("ref", F.coalesce(F.sum("w").over(win), F.lit(0)))
    j = got.join(want, ["g", "v"])
    assert j.filter(F.col("cum_w") != F.col("ref")).count() == 0
    assert j.count() == df.count()
    flat = exclusive_prefix(df.filter("g = 0").drop("g"), "v", ["w"], buckets=8)
    assert flat.count() == df.filter("g = 0").count()


def test_ordinal_codes_large_path(spark, monkeypatch):
    import tarmac.operators.encoders as enc
    monkeypatch.setattr(enc, "MAX_WINDOW_ROWS", 10)
    vals = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "value string")
    codes = ordinal_codes(vals.repartition(7), 500)
    got = {r["value"]: r["code"] for r in codes.collect()}
    assert got == {f"k{i:04d}": i for i in range(500)}


def test_split_disjoint_complete_repeatable(spark, sf):
    df = Q.cleaned(spark, sf).select("flight_key")
    a = df.withColumn("t", hash_split_flag("flight_key"))
    b = df.withColumn("t", hash_split_flag("flight_key"))
    n = df.count()
    assert a.filter("t = 1").count() + a.filter("t = 0").count() == n
    assert a.exceptAll(b).count() == 0
    frac = a.filter("t = 1").count() / n
    assert 0.15 < frac < 0.25
    # equal keys always fall on the same side
    assert a.groupBy("flight_key").agg(F.countDistinct("t").alias("k")).filter("k > 1").count() == 0


def test_ks_self_is_zero_and_gate(spark, sf):
    log = T.prediction_log(spark, sf)
    res = ks_drift(log, log, features=[("distance", "distance"), ("month", "month")])
    assert all(r["ks_statistic"] == 0.0 for r in res.collect())
    small = log.orderBy("event_id").limit(10)
    assert gated_drift(log, small).count() == 0


def test_ks_matches_brute_force(spark, sf):
    n = T.table(spark, sf, "events").count()
    ref, prod = T.drift_pair(spark, sf, split_id=n // 2)
    d = ks_drift(ref, prod, features=[("value", "value")], buckets=8).first()["ks_statistic"]
    a = sorted(r["value"] for r in ref.collect())
    b = sorted(r["value"] for r in prod.collect())
    import bisect
    pts = sorted(set(a) | set(b))
    brute = max(abs(bisect.bisect_right(a, x) / len(a) - bisect.bisect_right(b, x) / len(b))
                for x in pts)
    assert d == pytest.approx(round(brute, 6), abs=1e-12)


# --- Fixed values: rows of a prediction log, as the original platform writes them ---
GOLDEN_LOG = [
    (dt.datetime(2026, 3, 1, 0, 10, 15, 52721), "AA", "JFK", "LAX", 7, 14, 2475, 5.0, 0, 0.1434),
    (dt.datetime(2026, 3, 1, 0, 40, 32, 535122), "AS", "LAX", "CLT", 5, 9, 2432, 0.0, 0, 0.0097),
    (dt.datetime(2026, 3, 1, 0, 42, 53, 981637), "NK", "LAX", "LAX", 7, 14, 2475, 2.0, 0, 0.1661),
    (dt.datetime(2026, 3, 1, 0, 50, 5, 708306), "AA", "ORD", "LAX", 7, 14, 2475, 2.0, 0, 0.1606),
]


def test_golden_prediction_log(spark, sf):
    from tarmac.sources.files import LOG_SCHEMA
    log = spark.createDataFrame(GOLDEN_LOG, LOG_SCHEMA)
    k = A.prediction_stats(log).first()
    assert k["total_predictions"] == 4 and k["delayed_rate"] == 0.0
    assert k["avg_probability"] == pytest.approx(0.11995)
    by = {r["carrier"]: r["predictions"] for r in A.predictions_by_carrier(log).collect()}
    assert by == {"AA": 2, "AS": 1, "NK": 1}
    ref = Q.processed(spark, sf, keep_key=False)
    assert gated_drift(ref, log).count() == 0   # 4 < 30


def test_drift_report_shape(spark, sf):
    ref, prod = Q._drift_inputs(spark, sf)
    res = ks_drift(ref, prod)
    rep = drift_report(res, ref.count(), prod.count()).first()
    assert set(rep["features"].keys()) == {"distance", "dep_delay", "dep_hour", "month"}
    assert isinstance(rep["any_drift"], bool)


def test_empty_log_stats(spark):
    from tarmac.sources.files import LOG_SCHEMA
    empty = spark.createDataFrame([], LOG_SCHEMA)
    k = A.prediction_stats(empty).first()
    assert k["total_predictions"] == 0 and k["first_prediction"] is None
    assert A.predictions_by_carrier(empty).count() == 0


def test_auc_matches_spark_evaluator(spark, sf):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    s = T.scored(spark, sf).select(F.col("label").cast("double").alias("label"),
                                   F.col("score").cast("double").alias("rawPrediction"))
    ours = roc_auc(T.scored(spark, sf)).first()["roc_auc"]
    theirs = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(s)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_stratified_split_exact_counts(spark, sf):
    from tarmac.plans.training import stratified_split_flag
    df = Q.cleaned(spark, sf)
    flagged = df.withColumn("t", stratified_split_flag(df))
    dup = df.groupBy("flight_key").count().agg(F.max("count")).first()[0]
    for r in flagged.groupBy("is_delayed").agg(F.count(F.lit(1)).alias("n"),
                                               F.sum("t").alias("k")).collect():
        target = -(-r["n"] // 5)
        assert target <= r["k"] < target + dup
    again = df.withColumn("t", stratified_split_flag(df))
    assert flagged.exceptAll(again).count() == 0


def test_stratified_cuts_read_their_input_twice(spark):
    from tarmac.plans.training import hash_bucket, stratified_cuts
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    # Keys repeat, class 2 is one group, and rows without a label or a key take part as they are.
    df = spark.range(5000).select(F.expr("CASE WHEN id % 500 <> 7 THEN concat('k', id % 2003) END").alias("flight_key"),
                                  F.expr("CASE WHEN id % 100 = 0 THEN NULL ELSE CAST(id % 3 = 0 AS int) END").alias("is_delayed"))
    df = df.union(spark.range(9).selectExpr("'one'", "2"))
    got = {f: stratified_cuts(df, test_fraction=f) for f in (0.2, 0.5, 1.0)}
    assert stratified_cuts(df.mapInArrow(count, df.schema)) == got[0.2] and seen.value == 2 * 5009
    rows = df.filter("is_delayed IS NOT NULL").select("is_delayed", hash_bucket("flight_key").alias("h")).collect()
    for fraction, cuts in got.items():
        for y in (0, 1, 2):
            hashes = sorted(r.h for r in rows if r.is_delayed == y)
            want = [h for h in hashes if sum(x < h for x in hashes) >= -(-len(hashes) * int(10 * fraction) // 10)]
            assert cuts[y] == (want[0] if want else 1 << 32), (fraction, y)
    assert stratified_cuts(df.limit(0)) == {}
