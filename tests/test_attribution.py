"""Fits on data with a planted signal; attributions against subset enumeration."""

import datetime as dt
import itertools
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tiercast import ModelParams, PanelConfig
from tiercast.operators import attribution, boosting, importance, matrix, metrics, splits

N_FEATURES = 4
NAMES = ["strong", "weak", "noise", "constant"]


def config(depth=3, trees=6):
    return PanelConfig(n_folds=3, model=ModelParams(trees=trees, depth=depth, learning_rate=0.3, feature_share=1.0, min_rows_per_leaf=5))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for u in range(600):
        for m in (1, 2):
            x = [float(rng.randint(0, 9)), float(rng.randint(0, 4)), rng.random(), 1.0]
            p = 1 / (1 + math.exp(6 - x[0] - 0.3 * x[1]))
            data.append((u, dt.date(2024, m, 28), int(rng.random() < p), x))
    return spark.createDataFrame(data, "user_id bigint, snapshot_t date, engaged int, x array<double>").cache()


@pytest.fixture(scope="module", params=[2, 3, 4])
def fitted(request, rows):
    cfg = config(depth=request.param)
    folded = splits.group_folds(rows, cfg.n_folds, cfg.seed).cache()
    models = boosting.fit_folds(folded, 1.5, cfg)
    nodes = boosting.tree_nodes(rows.sparkSession, models).cache()
    return folded, models, nodes


def conditional_value(nodes, node, x, known):
    """Tree output with unknown features averaged by training weight."""
    if node.left < 0:
        return node.prediction
    left, right = nodes[node.left], nodes[node.right]
    if node.feature in known:
        return conditional_value(nodes, left if x[node.feature] <= node.threshold else right, x, known)
    return (
        left.cover * conditional_value(nodes, left, x, known)
        + right.cover * conditional_value(nodes, right, x, known)
    ) / node.cover


def shapley(trees, x):
    phi = [0.0] * N_FEATURES
    for j in range(N_FEATURES):
        others = [k for k in range(N_FEATURES) if k != j]
        for size in range(N_FEATURES):
            w = math.factorial(size) * math.factorial(N_FEATURES - size - 1) / math.factorial(N_FEATURES)
            for s in itertools.combinations(others, size):
                for nodes in trees:
                    scale = 2 * nodes[0].tree_weight * w
                    phi[j] += scale * (
                        conditional_value(nodes, nodes[0], x, {*s, j}) - conditional_value(nodes, nodes[0], x, set(s))
                    )
    return phi


def test_attributions_equal_subset_enumeration(spark, fitted):
    folded, _, nodes = fitted
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.fold, {}).setdefault(n.tree, {})[n.node] = n
    sample = folded.orderBy("user_id", "snapshot_t").limit(40)
    got = attribution.attribute(sample, attribution.leaf_table(nodes), matrix.feature_table(spark, NAMES))
    phi = {(r.user_id, r.snapshot_t, r.sub_feature): r.phi for r in got.collect()}
    for r in sample.collect():
        for name, want in zip(NAMES, shapley(list(trees[r.fold].values()), r.x)):
            assert phi.get((r.user_id, r.snapshot_t, name), 0.0) == pytest.approx(want, abs=1e-12)


def test_base_and_attributions_add_up_to_the_log_odds(spark, fitted):
    folded, models, nodes = fitted
    leaves = attribution.leaf_table(nodes)
    keys = ["user_id", "snapshot_t"]
    total = attribution.attribute(folded, leaves, matrix.feature_table(spark, NAMES)).groupBy(*keys).agg(F.sum("phi").alias("s"))
    off = (
        boosting.oof_scores(folded, models).join(total, keys, "left").join(attribution.base_values(leaves), "fold")
        .select(F.max(F.abs(F.coalesce("s", F.lit(0.0)) + F.col("base") - F.log(F.col("score") / (1 - F.col("score"))))))
    )
    assert off.first()[0] < 1e-9


def test_several_passes_give_the_same(spark, fitted, monkeypatch):
    folded, _, nodes = fitted
    leaves, features = attribution.leaf_table(nodes), matrix.feature_table(spark, NAMES)
    one = attribution.attribute(folded, leaves, features)
    monkeypatch.setattr(attribution, "MAX_LEAVES", 30)
    many = attribution.attribute(folded, leaves, features)
    rounded = [F.round(c, 9).alias(c) for c in ("value", "phi")]
    assert one.select("user_id", "snapshot_t", "sub_feature", *rounded).exceptAll(
        many.select("user_id", "snapshot_t", "sub_feature", *rounded)
    ).isEmpty()


def test_planted_signal_is_found_and_noise_is_not(spark, rows, fitted):
    folded, models, nodes = fitted
    scored = boosting.oof_scores(folded, models).cache()
    assert scored.count() == rows.count()
    assert metrics.roc_auc(scored).first().roc_auc > 0.85
    features = matrix.feature_table(spark, NAMES)
    phi = attribution.attribute(folded, attribution.leaf_table(nodes), features)
    values = rows.select(F.posexplode("x").alias("idx", "value")).join(features, "idx").filter("value <> 0")
    table = importance.importance_table(
        importance.mean_abs(phi, rows, features),
        importance.gain(nodes, features, 3),
        importance.direction(phi, values, rows, features),
    ).collect()
    assert table[0].sub_feature == "strong" and table[0].direction == 1.0 and table[0].gain > 0
    last = {r.sub_feature: r for r in table}["constant"]
    assert (last.mean_abs_shap, last.gain, last.direction) == (0.0, 0.0, 0.0)


def test_shuffled_labels_score_near_one_half(rows):
    cfg = config()
    folded = splits.group_folds(splits.permute_labels(rows, cfg.seed), cfg.n_folds, cfg.seed).cache()
    models = boosting.fit_folds(folded, 1.0, cfg)
    assert abs(metrics.roc_auc(boosting.oof_scores(folded, models)).first().roc_auc - 0.5) < 0.06


def test_a_fit_repeats(rows):
    cfg = config(trees=3)
    first, second = (boosting.score(rows, boosting.fit(rows, 1.5, cfg)) for _ in range(2))
    assert first.drop("x").exceptAll(second.drop("x")).isEmpty()


def test_a_fit_does_not_depend_on_the_session(spark, rows):
    cfg, before = config(trees=3), spark.conf.get("spark.sql.shuffle.partitions")
    cfg = replace(cfg, fit_rows_per_task=200)
    got = []
    try:
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scored = boosting.score(rows, boosting.fit(rows, 1.5, cfg)).drop("x")
            got.append({(r.user_id, r.snapshot_t): r.score for r in scored.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_equal_means_after_rounding_keep_their_order(spark):
    means = spark.createDataFrame([("a", 0.0112), ("b", 0.0114), ("c", 0.5)], "sub_feature string, mean_abs_shap double")
    gains = means.select("sub_feature", F.lit(1.0).alias("gain"))
    directions = means.select("sub_feature", F.lit(1.0).alias("direction"))
    table = importance.importance_table(means, gains, directions).collect()
    assert [(r.rank, r.sub_feature, r.mean_abs_shap) for r in table] == [(1, "c", 0.5), (2, "b", 0.011), (3, "a", 0.011)]


def test_model_round_trip(spark, rows, tmp_path):
    model = boosting.fit(rows, 1.5, config(trees=2))
    boosting.save_model(model, NAMES, str(tmp_path / "m"))
    loaded, names = boosting.load_model(spark, str(tmp_path / "m"))
    assert names == NAMES
    assert boosting.score(rows, model).drop("x").exceptAll(boosting.score(rows, loaded).drop("x")).isEmpty()
    with pytest.raises(FileNotFoundError, match="train and save"):
        boosting.load_model(spark, str(tmp_path / "none"))


# --- rankings on hand-made attributions ----------------------------------------

T1, T2 = dt.date(2024, 1, 31), dt.date(2024, 2, 29)


@pytest.fixture(scope="module")
def hand_made(spark):
    rows = spark.createDataFrame([(u, t) for u in (1, 2) for t in (T1, T2)], "user_id int, snapshot_t date")
    phi = spark.createDataFrame(
        [
            (1, T1, "up", 1.0, 0.5), (2, T1, "up", 0.0, -0.5), (1, T2, "up", 2.0, 1.0),
            (1, T1, "down", 1.0, -0.4),
            *[(u, t, "flat phi", float(u), 0.25) for u in (1, 2) for t in (T1, T2)],
            (1, T1, "flat value", 3.0, 0.1), (2, T1, "flat value", 3.0, 0.2),
        ],
        "user_id int, snapshot_t date, sub_feature string, value double, phi double",
    )
    values = phi.filter("value <> 0 and sub_feature <> 'flat value'").select("sub_feature", "value").unionByName(
        spark.createDataFrame([("flat value", 3.0)] * 4, "sub_feature string, value double")
    )
    features = matrix.feature_table(spark, ["down", "flat phi", "flat value", "unused", "up"])
    return phi, values, rows, features


def test_direction(hand_made):
    got = {r.sub_feature: r.direction for r in importance.direction(*hand_made).collect()}
    assert got == {"up": 1.0, "down": -1.0, "flat phi": None, "flat value": 0.0, "unused": 0.0}


def test_used_value_without_attribution_has_no_direction(spark, hand_made):
    phi, values, rows, features = hand_made
    got = importance.direction(phi.filter("sub_feature <> 'up'"), values, rows, features)
    assert {r.sub_feature: r.direction for r in got.collect()}["up"] is None


def test_rankings(spark, hand_made):
    phi, _, rows, features = hand_made
    means = {r.sub_feature: r.mean_abs_shap for r in importance.mean_abs(phi, rows, features).collect()}
    assert means == pytest.approx({"up": 0.5, "down": 0.1, "flat phi": 0.25, "flat value": 0.075, "unused": 0.0})
    top = importance.by_snapshot(phi, rows, features, 2).collect()
    assert [(r.snapshot_t, r.n_rows, r.sub_feature, r.mean_abs_shap) for r in top] == [
        (T2, 2, "up", 0.5), (T2, 2, "flat phi", 0.25), (T1, 2, "up", 0.5), (T1, 2, "flat phi", 0.25),
    ]
    assert importance.by_snapshot(phi, rows, features, 10).count() == 10
    assert {r.snapshot_t for r in importance.latest(importance.by_snapshot(phi, rows, features, 2)).collect()} == {T2}


def test_rounding_is_half_even_and_comes_after_sorting(spark):
    means = spark.createDataFrame([("a", 0.0125), ("b", 0.01251)], "sub_feature string, mean_abs_shap double")
    assert [tuple(r) for r in importance.live_ranking(means).collect()] == [(1, "b", 0.013), (2, "a", 0.012)]


def test_per_row_table(spark, hand_made):
    phi, _, rows, _ = hand_made
    scored = rows.withColumn("engaged", F.lit(1)).withColumn("score", F.lit(0.25))
    wide = importance.per_row(scored, phi, ["up", "down"])
    assert wide.columns == ["user_id", "snapshot_t", "engaged", "engaged_probability", "shap__up", "shap__down"]
    got = {(r.user_id, r.snapshot_t): tuple(r[4:]) for r in wide.collect()}
    assert got == {(1, T1): (0.5, -0.4), (2, T1): (-0.5, 0.0), (1, T2): (1.0, 0.0), (2, T2): (0.0, 0.0)}
