"""Physical-plan properties: checked broadcasts, pruned scans, pushed filters."""
from pyspark.sql import functions as F

from tarmac.operators.joins import lookup_join, spread_for_heavy_work
from tarmac.plans import queries as Q
from tarmac.sources import testdata as T


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_join_broadcasts_only_under_bound(spark, sf):
    fact = T.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    dim = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    small = lookup_join(fact, dim, "l_suppkey", "inner", max_rows=10 ** 6)
    assert "BroadcastHashJoin" in plan_text(small)
    with _no_auto_broadcast(spark):
        big = lookup_join(fact, dim, "l_suppkey", "inner", max_rows=0)
        assert "BroadcastHashJoin" not in plan_text(big)
        assert big.count() == small.count()


class _no_auto_broadcast:
    """Turn off size-estimate broadcasts so only explicit hints broadcast."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        self.old_aqe = self.spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
        self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        self.spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        return self

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", self.old)
        if self.old_aqe is None:
            self.spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            self.spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", self.old_aqe)


def test_fact_scan_is_pruned_and_filtered(spark, sf):
    df = Q.delay_rate_by_carrier(spark, sf)
    df.explain()  # plan is printed for the log
    text = df._jdf.queryExecution().executedPlan().toString()
    # lineitem is read with only the columns the query needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint" in text
    assert "l_tax" not in text and "l_returnflag" not in text and "l_shipdate" not in text
    # the operated-flight rule is evaluated next to the scan, before any join
    assert "% 50) = 0)" in text


def test_reread_is_column_pruned(spark, sf, tmp):
    from tarmac.sources.files import read_processed, write_processed
    write_processed(Q.processed(spark, sf), f"{tmp}/p")
    df = read_processed(spark, f"{tmp}/p", ["Reporting_Airline", "is_delayed"]).filter(
        F.col("is_delayed") == 1)
    text = plan_text(df)
    assert "ReadSchema: struct<Reporting_Airline:string,is_delayed:int>" in text
    assert "PushedFilters: [IsNotNull(is_delayed), EqualTo(is_delayed,1)]" in text


def test_spread_only_small_partition_counts(spark):
    one = spark.range(100).coalesce(1)
    assert spread_for_heavy_work(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(10 ** 12)
    assert spread_for_heavy_work(many) is many


def test_spread_goes_by_the_files_of_a_join(spark, sf):
    from tarmac.plans.training import prepare
    flights = T.flights_raw(spark, sf)  # a join of a few small files: Spark's estimate of it is their product
    cores = spark.sparkContext.defaultParallelism
    assert flights.rdd.getNumPartitions() < cores == spread_for_heavy_work(flights).rdd.getNumPartitions()
    rows = prepare(Q.processed(spark, sf)).data.groupBy(F.input_file_name()).count().collect()
    assert len(rows) >= cores and max(r["count"] for r in rows) < 2 * min(r["count"] for r in rows)


def test_spread_starts_no_job(spark, sf):
    sc = spark.sparkContext
    shuffled = Q.delay_rate_by_carrier(spark, sf).repartition(3, "Reporting_Airline")
    sc.setJobGroup("spread", "no job")
    spread_for_heavy_work(shuffled)
    jobs = sc.statusTracker().getJobIdsForGroup("spread")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0


def test_auc_reads_its_input_once(spark, tmp):
    from tarmac.operators.metrics import roc_auc
    spark.range(5000).selectExpr("id % 2 AS label", "(id % 97) / 97.0D AS score").write.parquet(f"{tmp}/scores")
    plan = roc_auc(spark.read.parquet(f"{tmp}/scores"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0  # what is left reads the kept counts


def test_range_count_follows_the_input(spark):
    from tarmac.operators.cumulative import range_count
    assert range_count(spark.range(10 ** 11)) > range_count(spark.range(1000)) == 256


def test_fits_side_by_side_share_the_cores(spark):
    from tarmac.plans.training import own_lane
    cores = spark.sparkContext.defaultParallelism
    train, names = spark.range(0, 1000, 1, 4 * cores), ["LogisticRegression", "RandomForest", "GradientBoosting"]
    lanes = {n: own_lane(train, n, names) for n in names}
    assert all(x.count() == 1000 for x in lanes.values())
    widths = {n: x.rdd.getNumPartitions() for n, x in lanes.items()}
    assert all(2 <= w <= max(2, cores * 7 // 12) for w in widths.values()), widths
    assert own_lane(train, "RandomForest", ["RandomForest"]).rdd.getNumPartitions() == cores


def test_a_forest_in_parts_is_one_forest(spark, sf, tmp):
    from tarmac.functions import constants as K
    from tarmac.plans import queries as Q
    from tarmac.plans.training import Preset, fit_forest, load_model, make_estimator, prepare
    prepared = prepare(Q.processed(spark, sf).limit(800))
    path = f"{tmp}/rows"
    prepared.data.coalesce(1).write.parquet(path)
    rows, est = spark.read.parquet(path), make_estimator("RandomForest", Preset(1, 19, 5, 1, 1), float(prepared.n_train))
    narrow, wide = fit_forest(est, rows, 1), fit_forest(est, rows, 4)
    # Its trees are all there, differ, and do not follow the size of the cluster.
    debug = [[t._call_java("toDebugString").split("\n", 1)[1] for t in m.trees] for m in (narrow, wide)]
    assert debug[0] == debug[1] and len(set(debug[0])) == narrow.getNumTrees == 19
    assert narrow.getMaxDepth() == 5 and narrow.getSeed() == K.SPLIT_SEED
    assert abs(narrow.featureImportances.toArray().sum() - 1) < 1e-9
    narrow.write().save(f"{tmp}/forest")
    loaded = load_model("RandomForest", f"{tmp}/forest")
    answers = [m.transform(rows).select("flight_key", "probability", "prediction").collect() for m in (narrow, loaded)]
    assert loaded.getNumTrees == 19 and answers[0] == answers[1]
    assert {r["prediction"] for r in answers[0]} == {0.0, 1.0}


def test_the_training_set_is_derived_once(spark, sf):
    from pyspark.sql import functions as F
    from tarmac.functions import constants as K
    from tarmac.plans import queries as Q
    from tarmac.plans.training import prepare
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(label):
        seen.add(1)
        return label

    rows = Q.processed(spark, sf).limit(500).localCheckpoint()
    prepared = prepare(rows.withColumn(K.TARGET, counted.asNondeterministic()(K.TARGET)))
    assert prepared.n_train + prepared.n_test == 500
    assert prepared.data.count() == 500 and seen.value == 500


def test_a_small_training_set_has_few_tasks(spark):
    from tarmac.plans.training import LANE_ROWS, own_lane
    train, names = spark.range(0, 1000, 1, 16), ["LogisticRegression", "GradientBoosting"]
    few = own_lane(train, "GradientBoosting", names, LANE_ROWS - 1)
    assert few.rdd.getNumPartitions() == 1 and few.count() == 1000
    wide = own_lane(train, "GradientBoosting", names, 100 * LANE_ROWS)
    assert wide.rdd.getNumPartitions() == own_lane(train, "GradientBoosting", names).rdd.getNumPartitions() > 1


def test_fits_read_a_finished_table(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    from tarmac.plans import queries as Q
    from tarmac.plans.training import prepare
    rows = Q.processed(spark, sf).limit(500).localCheckpoint()
    prepared = prepare(rows)
    # Rows come scaled and assembled, as no task of a fit should do it again.
    plan = prepared.data.filter("is_test = 0").select("label", "weight", "features")._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and plan.count("Relation") == 1
    want = rows.select("flight_key", F.array(*prepared.scaler.columns()).alias("x")).groupBy("flight_key").agg(F.sort_array(F.collect_list("x")))
    got = prepared.data.select("flight_key", vector_to_array("features").alias("x")).groupBy("flight_key").agg(F.sort_array(F.collect_list("x")))
    assert want.count() == got.count() > 0 and want.exceptAll(got).count() == 0
