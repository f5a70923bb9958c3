"""Steps go over their input once, and fits that run side by side leave each other room."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tiercast import ModelParams
from tiercast.config import PanelConfig
from tiercast.operators import boosting, importance, population, splits
from tiercast.plans import run as runs
from tiercast.plans.training import TrainingRun
from tiercast.sources.testdata import personas

DAY = dt.date(2024, 1, 31)


@pytest.fixture
def counted(spark):
    """Gives a frame whose rows are counted each time they are read, and the count so far."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return lambda df: df.mapInArrow(through, df.schema), lambda: seen.value


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def folded(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("user_id"), F.lit(DAY).alias("snapshot_t"), (F.col("id") % 3 == 0).cast("int").alias("engaged"),
        (F.col("id") % 5).cast("int").alias("fold"),
        F.array(F.rand(1), (F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")).alias("x"))


def test_large_fits_run_one_by_one_and_small_ones_together():
    cfg = PanelConfig()
    assert boosting.fits_at_once(40_000, 117, 8, cfg) == cfg.parallel_fits
    assert boosting.fits_at_once(20_000_000, 117, 12, cfg) == 1
    assert boosting.fits_at_once(20_000_000, 117, 4 * boosting.MAX_TASKS, cfg) == 4  # else cores would stand idle
    assert boosting.fits_at_once(0, 0, 8, cfg) == cfg.parallel_fits


def test_five_fits_read_their_rows_twice_in_all(spark, counted):
    """Once to count them, once to lay them out; the models are those of separate fits."""
    cfg = replace(PanelConfig(), model=ModelParams(trees=2), fit_rows_per_task=100)
    rows = folded(spark)
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keys())
    count, seen = counted
    models = boosting.fit_folds(count(rows), 2.0, cfg)
    assert seen() == 2 * 300
    alone = boosting.fit(rows.filter("fold <> 1"), 2.0, cfg)
    assert models[1].toDebugString.split("\n")[1:] == alone.toDebugString.split("\n")[1:]
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keys()) <= kept  # no copy stays


def test_folds_of_unlike_sizes_are_laid_out_by_their_own_tasks(spark):
    """Fold 0 holds so much that the fit without it has fewer tasks; its model is that of a fit alone."""
    cfg = replace(PanelConfig(), model=ModelParams(trees=2), fit_rows_per_task=100)
    rows = folded(spark, 500).withColumn("fold", F.when(F.col("user_id") < 300, 0).otherwise(F.col("fold")))
    models = boosting.fit_folds(rows, 2.0, cfg)
    for k in (0, 3):
        alone = boosting.fit(rows.filter(F.col("fold") != k), 2.0, cfg)
        assert models[k].toDebugString.split("\n")[1:] == alone.toDebugString.split("\n")[1:]


def test_values_are_read_once_for_the_direction(spark, counted):
    phi = spark.range(20).select(
        F.col("id").alias("user_id"), F.lit(DAY).alias("snapshot_t"), F.lit("f").alias("sub_feature"),
        F.col("id").cast("double").alias("value"), F.col("id").cast("double").alias("phi"))
    count, seen = counted
    out = importance.direction(
        phi, count(phi.select("sub_feature", "value")), phi.select("user_id", "snapshot_t"),
        spark.createDataFrame([(0, "f")], "idx int, sub_feature string"))
    assert out.first().direction == 1.0 and seen() == 20


def test_labels_are_dealt_once_for_the_permuted_fits(work, counted, monkeypatch):
    count, seen = counted
    deal = splits.permute_labels
    monkeypatch.setattr(splits, "permute_labels", lambda *a, **k: count(deal(*a, **k)))
    TrainingRun(work.panel, replace(work.cfg, model=ModelParams(trees=1))).permuted
    assert seen() == work.panel.rows.count()


def test_rows_are_scored_once_for_the_metrics_in_sample(work):
    assert "signature" not in plan_of(work.run.fold_metrics())


def test_segment_coverage_joins_nothing(spark):
    personas = spark.createDataFrame(
        [(1, 7, DAY), (1, 8, DAY), (2, 9, DAY), (None, 5, DAY), (3, None, DAY)], "user_id int, acct_id int, score_date date")
    segments = spark.createDataFrame(
        [(1, DAY, "Paid"), (1, DAY, "Other"), (None, DAY, "Paid"), (9, DAY, "Paid")], "user_id int, snapshot_t date, customer_segment string")
    days = spark.createDataFrame([(DAY,)], "snapshot_t date")
    out = population.segment_coverage(personas, segments, days)
    assert tuple(out.first()) == (1, 3) and "Join" not in plan_of(out)
    assert tuple(population.segment_coverage(personas.limit(0), segments, days).first()) == (0, 0)


def test_usage_is_read_once_for_the_tier_history(spark, counted):
    usage = spark.createDataFrame(
        [(1, dt.date(2024, 1, 30), 4), (1, dt.date(2024, 3, 5), 1), (2, dt.date(2024, 1, 31), None), (None, DAY, 3), (3, None, 2)],
        "user_id bigint, time_period date, event_count bigint")
    count, seen = counted
    rows = {(r.user_id, r.score_date and f"{r.score_date:%m-%d}"): r.user_category_persona for r in personas(count(usage)).collect()}
    assert seen() == 2 * 5  # the span of its days, and the rows
    assert rows[1, "01-30"] == "New" and rows[1, "03-30"] == "Casual" and rows[2, "01-31"] == "Inactive" and rows[3, None] == "Inactive"
    assert rows[None, "01-31"] == "Inactive" and len(rows) == 5 + 4 + 4 + 1


def test_grid_days_and_horizon_of_a_run_need_no_shuffle(spark, tmp_path):
    days = spark.range(50).select(
        F.col("id").alias("user_id"), F.col("id").alias("acct_id"), F.lit(DAY).alias("score_date"),
        F.lit("Core").alias("user_category_persona"), F.lit(False).alias("is_test_a"), F.lit(False).alias("is_test_b"))
    runs.write_personas(days, str(tmp_path))
    runs.write_facts(spark, str(tmp_path), PanelConfig())
    assert "Aggregate" not in plan_of(runs.read_spans(spark, str(tmp_path)))
    grid = spark.createDataFrame(
        [(DAY, dt.date(2024, 1, 2), dt.date(2024, 3, 1), True, True)],
        "snapshot_t date, window_start date, check_day date, is_training boolean, is_live boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # a shuffle would leave one file
    try:
        copies = spark.read.parquet(f"{tmp_path}/personas").inputFiles()
        runs.write_tier_days(spark, str(tmp_path), grid)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    back = runs.read_tier_days(spark, str(tmp_path))
    assert back.count() == 50 and len(copies) > 1 and len(back.inputFiles()) > 1
