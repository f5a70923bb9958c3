"""The complete run, its files, and the edges of the live forecast."""

import glob
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tiercast import ModelParams
from tiercast.operators import boosting, importance
from tiercast.plans.live import forecast
from tiercast.plans.run import PanelTables, run_panel, score_month
from tiercast.plans.training import TrainingRun
from tiercast.sources.tables import PERSONA_COLUMNS, PERSONA_RENAMES, ingest_personas, scan


@pytest.fixture(scope="module")
def outcome(spark, work, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    t = work.tables
    cfg = replace(work.cfg, model=ModelParams(trees=2))
    report = run_panel(spark, PanelTables(t.usage, t.catalog, t.personas, t.account_state), cfg, out)
    return out, {r.metric: r.value for r in report.collect()}, cfg


def read_csv(spark, path):
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def test_report(outcome):
    _, report, _ = outcome
    assert report["panel_n_rows"] == 544 and report["panel_n_pos"] == 20 and report["panel_n_users"] == 129
    assert report["users_n_before"] - report["users_n_excluded"] == report["users_n_after"]
    assert 0 <= report["oof_roc_auc"] <= 1 and 0 <= report["permuted_roc_auc"] <= 1
    assert report["mean_gap"] == pytest.approx(report["mean_train_auc"] - report["mean_validation_auc"])


def test_ranking_files(spark, outcome):
    out, report, _ = outcome
    ranking = read_csv(spark, f"{out}/importance")
    assert ranking.columns == ["sub_feature", "mean_abs_shap", "gain", "direction"]
    assert ranking.count() == report["panel_n_features"]
    assert read_csv(spark, f"{out}/importance_top").collect() == ranking.limit(10).collect()
    per = read_csv(spark, f"{out}/importance_by_snapshot")
    assert per.columns == ["snapshot_t", "n_rows", "sub_feature", "mean_abs_shap"]
    counts = per.groupBy("snapshot_t").agg(F.count("*").alias("k"), F.max("n_rows").alias("n")).collect()
    assert {r.k for r in counts} == {10} and sum(r.n for r in counts) == report["panel_n_rows"]
    live = read_csv(spark, f"{out}/live_importance")
    assert live.columns == ["sub_feature", "mean_abs_shap"] and live.count() == report["panel_n_features"]
    assert len(glob.glob(f"{out}/importance/part-*.csv")) == 1


def test_row_level_files(spark, outcome):
    out, report, _ = outcome
    wide = read_csv(spark, f"{out}/attribution_per_row")
    assert wide.count() == report["panel_n_rows"] and len(wide.columns) == 44
    assert read_csv(spark, f"{out}/live_scores").columns == ["user_id", "snapshot_t", "forecast_probability"]
    usage = spark.read.parquet(f"{out}/usage_long")
    assert usage.count() == 2097 and "snapshot_t" in usage.columns
    assert len(glob.glob(f"{out}/usage_long/snapshot_t=*")) > 70
    assert spark.read.parquet(f"{out}/segments").count() == 9798


def test_saved_model_scores_like_the_run(spark, work, outcome):
    out, report, cfg = outcome
    model, names = boosting.load_model(spark, f"{out}/model")
    assert len(names) == report["panel_n_features"]
    p = work.panel
    again = forecast(model, names, work.tables.personas, p.usage_long, p.segments, p.grid, cfg)
    row = again.summary.first()
    assert row.n_at_risk == report["live_n_at_risk"]
    assert row.mean_probability == pytest.approx(report["live_mean_probability"])
    assert (row.month, row.check_day) == ("July 2001", "2001-08-30")


def test_ranking_files_follow_the_unrounded_order(spark, work, outcome):
    out, _, cfg = outcome
    run = TrainingRun(work.panel, cfg)
    exact = importance.ranked(importance.mean_abs(run.phi, work.panel.rows, work.panel.features()))
    names = [r.sub_feature for r in exact.collect()]
    assert [r.sub_feature for r in read_csv(spark, f"{out}/importance").collect()] == names
    assert [r.sub_feature for r in read_csv(spark, f"{out}/importance_top").collect()] == names[:10]


def test_scoring_a_month_without_training_gives_the_same_files(spark, outcome, tmp_path):
    out, report, cfg = outcome
    live = score_month(spark, out, cfg, str(tmp_path))
    for name in ("live_scores", "live_importance", "live_summary", "live_unseen_features"):
        again, first = read_csv(spark, f"{tmp_path}/{name}"), read_csv(spark, f"{out}/{name}")
        assert again.columns == first.columns and again.exceptAll(first).isEmpty() and first.exceptAll(again).isEmpty()
    assert live.summary.first().outcome_known is bool(report["live_outcome_known"])


def test_empty_live_cohort_ends_cleanly(spark, work, outcome):
    out, _, cfg = outcome
    model, names = boosting.load_model(spark, f"{out}/model")
    p = work.panel
    nobody = forecast(
        model, names, work.tables.personas, p.usage_long, p.segments.filter("false"), p.grid, cfg
    )
    assert nobody.scores.count() == nobody.ranking.count() == nobody.unseen.count() == 0
    assert nobody.summary.first().n_at_risk == 0


def test_holdout_users_are_never_in_the_pool(work):
    pool, test = work.run.holdout
    assert pool.join(test, "user_id", "left_semi").isEmpty()
    assert pool.count() + test.count() == work.panel.rows.count()
    assert work.run.pool.folded.join(test, "user_id", "left_semi").isEmpty()


def test_persona_ingest(spark):
    raw = spark.createDataFrame([tuple(str(i) for i in range(21))], [*PERSONA_COLUMNS, "unused"])
    got = ingest_personas(raw)
    assert len(PERSONA_RENAMES) == 14 and len(got.columns) == 22
    row = got.first()
    assert row.score_date == "2" and row.is_test_a is False and "unused" not in got.columns
    assert {"user_category_persona", "login_ratio", "feature_adoption_persona"} <= set(got.columns)


def test_scan_reads_tables_and_folders(spark):
    spark.range(3).withColumn("b", F.lit(1)).createOrReplaceTempView("some_table")
    assert scan(spark, "some_table", ["id"]).columns == ["id"]
    assert scan(spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey"]).columns == ["o_orderkey"]
