"""Sparse vectors against dense ones, and a fit on a long feature list."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from test_attribution import NAMES, config, fitted, rows  # noqa: F401
from test_signatures import furthest
from tiercast import ModelParams
from tiercast.functions.vectors import ml_vector, sparse, value_at
from tiercast.operators import attribution, boosting, matrix, signatures
from tiercast.operators.population import KEYS


def thinned(dense):
    """The same rows with their zero cells left out."""
    at = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda c: c["v"] != 0)
    return dense.withColumn("_c", at).withColumn("x", sparse(F.col("_c.i"), F.col("_c.v"), len(NAMES))).drop("_c")


def test_values_of_both_forms(spark):
    dense = spark.createDataFrame([([0.0, 1 / 3, 0.0, 5e-324],), ([0.0] * 4,), ([1e300, 2.0, 3.0, 4.0],)], "x array<double>")
    thin = thinned(dense)
    for frame in (dense, thin):
        got = [tuple(r) for r in frame.select(*[value_at(frame, F.lit(i)).alias(f"v{i}") for i in range(4)]).collect()]
        assert got == [(0.0, 1 / 3, 0.0, 5e-324), (0.0,) * 4, (1e300, 2.0, 3.0, 4.0)]
        assert [r[0].toArray().tolist() for r in frame.select(ml_vector(frame)).collect()] == [list(g) for g in got]
    assert thin.select(ml_vector(thin)).first()[0].indices.tolist() == [1, 3]


def test_fits_scores_and_attributions_do_not_depend_on_the_form(spark, rows, fitted):  # noqa: F811
    folded, models, nodes = fitted
    thin = thinned(folded)
    cfg = config()
    # Only splits are compared: a threshold is a midpoint of sampled values in either form.
    one, other = (boosting.fit(r.drop("fold"), 1.5, replace(cfg, model=replace(cfg.model, trees=3))) for r in (folded, thin))
    assert one.toDebugString.split("\n")[1:] == other.toDebugString.split("\n")[1:]
    assert furthest(boosting.oof_scores(folded, models), boosting.oof_scores(thin, models), [*KEYS, "fold"], "score") == 0
    features, leaves = matrix.feature_table(spark, NAMES), attribution.leaf_table(nodes)
    keep = F.abs("phi") > 1e-12
    by_leaf = [attribution.attribute(r, leaves, features).where(keep) for r in (folded, thin)]
    assert furthest(*by_leaf, [*KEYS, "sub_feature"], "phi") < 1e-12
    assert furthest(*by_leaf, [*KEYS, "sub_feature"], "value") == 0
    tables = signatures.signatures(nodes)
    if tables is not None:
        assert furthest(signatures.out_of_fold(folded, tables), signatures.out_of_fold(thin, tables), [*KEYS, "fold"], "score") < 1e-12
        met = [signatures.attribute(r, tables, features).where(keep) for r in (folded, thin)]
        assert furthest(*met, [*KEYS, "sub_feature"], "value") == 0


def test_a_fit_on_twenty_thousand_features(spark):
    size, day = 20_000, dt.date(2024, 1, 31)
    users = spark.range(300).select(
        F.format_string("u%03d", "id").alias("user_id"), F.lit(day).alias("snapshot_t"), (F.col("id") % 2).cast("int").alias("engaged"))
    # Each user uses 70 features of their own; one feature far down the list tells the labels apart.
    noise = spark.range(300 * 70).select(
        F.format_string("u%03d", F.floor(F.col("id") / 70)).alias("user_id"), F.format_string("f%05d", F.col("id") % size).alias("sub_feature"))
    signal = users.filter("engaged = 1").select("user_id", F.lit("f19990").alias("sub_feature"))
    usage = noise.unionByName(signal).select(
        "user_id", F.lit(day).alias("snapshot_t"), "sub_feature", F.lit(3).cast("long").alias("early_events"))
    names = matrix.feature_names(matrix.feature_list(usage))
    assert len(names) == size
    features = matrix.feature_table(spark, names)
    laid = matrix.sparse_rows(users, usage, features, size).cache()
    assert laid.select(F.max(F.size("x.indices"))).first()[0] <= 71
    cfg = replace(config(), model=ModelParams(trees=2, depth=2, learning_rate=0.3, row_share=1.0, feature_share=1.0, min_rows_per_leaf=5))
    model = boosting.fit(laid, 1.0, cfg)
    assert model.numFeatures == size
    nodes = boosting.tree_nodes(spark, {0: model})
    tables = signatures.signatures(nodes)
    named = laid.withColumn("model", F.lit(0)).drop("engaged")
    scores = {r.user_id: r.score for r in signatures.score(named, tables).collect()}
    truth = {r.user_id: r.engaged for r in users.collect()}
    assert min(s for u, s in scores.items() if truth[u]) > max(s for u, s in scores.items() if not truth[u])
    phi = signatures.attribute(laid.drop("engaged").withColumn("fold", F.lit(0)), tables, features)
    best = phi.groupBy("sub_feature").agg(F.sum(F.abs("phi")).alias("s")).orderBy(F.desc("s")).first()
    assert best.sub_feature == "f19990"
    assert furthest(boosting.score(laid, model), signatures.score(named, tables), KEYS, "score") < 1e-9
