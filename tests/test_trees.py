"""Trees grown inside tasks against Spark ML's own fits."""
import numpy as np
import pytest
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassificationModel, GBTClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tarmac.operators import trees as T


@pytest.fixture(scope="module")
def rows(spark):
    """Few and many values, two of them, and one; two weights."""
    rng, n = np.random.default_rng(1), 1500
    x = np.stack([rng.integers(0, 20, n), rng.integers(0, 2, n), rng.normal(size=n).round(1), rng.normal(size=n), np.ones(n)], 1)
    y = x[:, 0] / 10 + x[:, 1] + x[:, 2] + rng.normal(size=n) * .7 > 1.5
    found = [(float(a), float(b), Vectors.dense(v)) for a, b, v in zip(y, rng.choice([0.7, 1.9], n), x.tolist())]
    return spark.createDataFrame(found, ["label", "weight", "features"]).repartition(3).cache()


def test_boosting_in_a_task_equals_sparks_in_few_jobs(spark, rows, tmp):
    est = GBTClassifier(maxIter=15, maxDepth=4, lossType="logistic", seed=42, stepSize=0.1)
    want = est.fit(rows)
    sc = spark.sparkContext
    sc.setJobGroup("boosting", "in a task")
    T.grow_boosted(est, rows, f"{tmp}/boosted")
    jobs = sc.statusTracker().getJobIdsForGroup("boosting")
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = GBTClassificationModel.load(f"{tmp}/boosted")
    assert len(jobs) < 20   # not one a level: those would be 60
    assert got.treeWeights == want.treeWeights and got.getMaxDepth() == 4 and got.numFeatures == 5
    assert [t.numNodes for t in got.trees] == [t.numNodes for t in want.trees]
    # Two splits may part the rows of a node alike: which is taken does not change their answers.
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=0.01)
    a, b = ([r[0][1] for r in m.transform(rows).select("rawPrediction").collect()] for m in (want, got))
    assert np.abs(np.array(a) - b).max() < 1e-9


def test_a_plain_class_tree_equals_sparks(spark, rows):
    want = DecisionTreeClassifier(maxDepth=6, weightCol="weight").fit(rows)
    sent, width = T._prepared(want, rows, True)
    bins, labels, weights, splits = sent.value
    grown = T.class_tree(bins, labels, weights, np.ones(len(bins), np.uint8), splits, 6, width, None)
    got = grown.rows(0, T.to_arrow_schema(T._parse(T.NODES)), splits).to_pylist()
    text, lines = [], want.toDebugString.split("\n")[1:]
    for r in got:
        n = r["nodeData"]
        text.append(f"Predict: {n['prediction']}" if n["leftChild"] < 0 else
                    f"If (feature {n['split']['featureIndex']} <= {n['split']['leftCategoriesOrThreshold'][0]})")
    want_text = [line.strip() for line in lines if line.strip().startswith(("If", "Predict"))]
    assert len(text) == len(want_text) and sum(a != b for a, b in zip(text, want_text)) <= 2, (text, want_text)
    leaves = [[line for line in x if line.startswith("Predict")] for x in (text, want_text)]
    assert leaves[0] == leaves[1]


def test_a_forest_in_tasks_is_sparks_kind_of_forest(spark, rows, tmp):
    est = RandomForestClassifier(numTrees=21, maxDepth=6, weightCol="weight", featureSubsetStrategy="sqrt", seed=3)
    judge = BinaryClassificationEvaluator().evaluate
    T.grow_forest(est, rows, f"{tmp}/forest")
    T.grow_forest(est, rows.repartition(7), f"{tmp}/again")
    got, again = (RandomForestClassificationModel.load(f"{tmp}/{p}") for p in ("forest", "again"))
    debug = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in (got, again)]
    # The same whatever the partitions; all trees are there and differ.
    assert debug[0] == debug[1] and len(set(debug[0])) == got.getNumTrees == 21
    assert got.numClasses == 2 and max(t.depth for t in got.trees) <= 6
    assert abs(got.featureImportances.toArray().sum() - 1) < 1e-9
    assert abs(judge(got.transform(rows)) - judge(est.fit(rows).transform(rows))) < 0.01


def test_answers_of_the_nodes_are_those_of_the_model(spark, rows, tmp):
    for est, grow, kind in ((GBTClassifier(maxIter=6, maxDepth=3), T.grow_boosted, GBTClassificationModel),
                            (RandomForestClassifier(numTrees=9, maxDepth=5, weightCol="weight", seed=-7), T.grow_forest, RandomForestClassificationModel)):
        grow(est, rows, f"{tmp}/{kind.__name__}")
        got = sorted(tuple(r) for r in T.predicted(rows, f"{tmp}/{kind.__name__}").collect())
        want = sorted((r[0], r[1], float(r[2][1])) for r in
                      kind.load(f"{tmp}/{kind.__name__}").transform(rows).select("label", "prediction", "probability").collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-12)


def test_thresholds_follow_the_weight(spark):
    values = np.arange(100.0)
    assert T.splits_of(values[:5], np.ones(5), 31).tolist() == [0.5, 1.5, 2.5, 3.5]
    assert T.splits_of(values, np.ones(100), 3).tolist() == [24.5, 49.5, 74.5]
    assert T.splits_of(values, np.append(1e6, np.ones(99)), 3).tolist() == [0.5, 1.5, 2.5]
    assert len(T.splits_of(values[:1], np.ones(1), 31)) == 0


def test_rows_without_a_split_make_one_leaf(spark, tmp):
    rows = spark.createDataFrame([(float(i % 2), 1.0, Vectors.dense([3.0, 4.0])) for i in range(10)], ["label", "weight", "features"])
    T.grow_boosted(GBTClassifier(maxIter=2), rows, f"{tmp}/flat")
    T.grow_forest(RandomForestClassifier(numTrees=3), rows, f"{tmp}/flat-forest")
    assert GBTClassificationModel.load(f"{tmp}/flat").totalNumNodes == 2
    assert RandomForestClassificationModel.load(f"{tmp}/flat-forest").totalNumNodes == 3
    assert T.predicted(rows, f"{tmp}/flat").filter(F.abs(F.col("p") - 0.5) < 1e-9).count() == 10


def test_large_sets_are_left_to_sparks_jobs():
    assert T.fits(468_650, 24) and not T.fits(10_000_000, 24) and not T.fits(0, 24)
