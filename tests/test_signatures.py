"""Scores and attributions by signature against Spark ML, leaves and subset enumeration."""

import pytest
from pyspark.sql import functions as F

from test_attribution import NAMES, N_FEATURES, fitted, rows, shapley  # noqa: F401
from tiercast.operators import attribution, boosting, matrix, signatures
from tiercast.operators.population import KEYS


@pytest.fixture(scope="module")
def tables(fitted):  # noqa: F811
    return signatures.signatures(fitted[2])


def furthest(a, b, keys, column):
    """Largest difference of a column between two frames with the same keys."""
    both = a.select(*keys, F.col(column).alias("a")).join(b.select(*keys, F.col(column).alias("b")), keys, "full")
    row = both.agg(F.max(F.abs(F.col("a") - F.col("b"))), F.count_if(F.col("a").isNull() | F.col("b").isNull()), F.count("*")).first()
    assert row[1] == 0 and row[2] > 0
    return row[0]


def test_scores_equal_spark_ml(fitted, tables):  # noqa: F811
    folded, models, nodes = fitted
    if tables is None:
        assert nodes.where("left >= 0").groupBy("fold", "tree").count().agg(F.max("count")).first()[0] > signatures.MAX_SPLITS
        return
    assert furthest(signatures.out_of_fold(folded, tables), boosting.oof_scores(folded, models), [*KEYS, "fold"], "score") < 1e-9
    inside = signatures.in_sample(folded, tables, 3)
    assert furthest(inside, boosting.in_sample_scores(folded, models), [*KEYS, "fold"], "score") < 1e-9


def test_attributions_equal_leaves_and_enumeration(spark, fitted, tables):  # noqa: F811
    folded, _, nodes = fitted
    if tables is None:
        return
    features = matrix.feature_table(spark, NAMES)
    got = signatures.attribute(folded, tables, features)
    leaves = attribution.attribute(folded, attribution.leaf_table(nodes), features)
    keep = F.abs("phi") > 1e-12
    assert furthest(got.where(keep), leaves.where(keep), [*KEYS, "sub_feature"], "phi") < 1e-9
    assert furthest(got.where(keep), leaves.where(keep), [*KEYS, "sub_feature"], "value") == 0
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.fold, {}).setdefault(n.tree, {})[n.node] = n
    sample = folded.orderBy("user_id", "snapshot_t").limit(20)
    phi = {(r.user_id, r.snapshot_t, r.sub_feature): r.phi for r in signatures.attribute(sample, tables, features).collect()}
    for r in sample.collect():
        for name, want in zip(NAMES, shapley(list(trees[r.fold].values()), r.x)):
            assert phi.get((r.user_id, r.snapshot_t, name), 0.0) == pytest.approx(want, abs=1e-12)


def test_rows_meet_trees_not_leaves(fitted, tables):  # noqa: F811
    """Per row and tree one lookup row, and at most as many cells as the tree has features."""
    folded, _, nodes = fitted
    if tables is None:
        return
    n = folded.count()
    met = signatures._met(folded.withColumn("model", F.col("fold")), tables)
    assert met.count() == n * nodes.select("tree").distinct().count()
    few = folded.sparkSession.createDataFrame(folded.limit(5).collect(), folded.schema)
    plan = signatures.score(few.withColumn("model", F.col("fold")), tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_a_tree_without_splits(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 0.5, 0, 0.25, 10.0, 0.0, -1, -1, -1, None)],
        "fold int, tree int, tree_weight double, node int, prediction double, cover double, gain double, left int, right int, feature int, threshold double")
    t = signatures.signatures(nodes)
    data = spark.createDataFrame([(1, 0, [1.0])], "user_id int, fold int, x array<double>")
    assert signatures.out_of_fold(data, t).first().score == pytest.approx(1 / (1 + 2.718281828459045 ** -0.25))
    assert signatures.attribute(data, t, matrix.feature_table(spark, ["a"]), ["user_id"]).count() == 0
