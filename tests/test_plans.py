"""Plan shapes, and results with one key holding a third of the rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tiercast import PanelConfig
from tiercast.checks.queries import QUERIES
from tiercast.operators import calendar, metrics, population, usage as usage_ops
from tiercast.operators.splits import fold_of_user, permute_labels
from tiercast.plans.live import live_usage

D = dt.date
# Queries over a global report or a sorted ranking, whose last step is one short list.
MODEL_FREE = [q for q in QUERIES if q not in {
    "oof_scores", "oof_metrics", "permutation_auc", "fold_metrics", "holdout_metrics", "gain_importance",
    "oof_attribution", "model_importance", "attribution_per_row", "live_scores", "live_importance",
    "live_summary", "run_metrics",
}]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MODEL_FREE)
def test_no_nested_loops_and_no_python_workers(name, work):
    plan = plan_of(QUERIES[name](work))
    assert not re.search(r"NestedLoop|CartesianProduct|EvalPython|InPandas|InArrow", plan)


def test_attribution_plan_stays_in_the_jvm(work):
    from tiercast.operators import attribution

    run = work.run
    cells = attribution.attribute(run.oof.folded, attribution.leaf_table(run.nodes), work.panel.features())
    plan = plan_of(cells)
    assert "BroadcastHashJoin [fold" in plan
    assert not re.search(r"NestedLoop|CartesianProduct|EvalPython|SortAggregate", plan)


def test_usage_scan_is_filtered_and_pruned(work):
    plan = plan_of(work.usage_long())
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "event_count" in line)
    assert "In(product, [Alpha,Beta])" in scan and "IsNotNull(sub_feature)" in scan
    assert plan.count("Exchange hashpartitioning(user_id") == 1


def test_history_laid_out_by_day_is_pruned_to_the_grid_days(spark, work, tmp_path):
    path = str(tmp_path / "personas")
    work.tables.personas.write.partitionBy("score_date").parquet(path)
    recent = calendar.recent(work.grid, 2)
    df = population.tiers_by_role(spark.read.parquet(path), recent)
    df.collect()
    days = {d for r in recent.collect() for d in (r.snapshot_t, r.check_day)}
    scans = [n for n in _nodes(df) if n.nodeName().startswith("Scan parquet")]
    assert [n.metrics().apply("numPartitions").value() for n in scans] == [len(days)]


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_usage_scan_reads_little_beyond_the_windows(spark, work, tmp_path, kind):
    """Date statistics prune, and so do those of timestamps stored as microseconds; Spark pushes no filter on the third kind."""
    days = work.tables.usage.withColumn("time_period", F.col("time_period").cast(kind))
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    days.repartitionByRange(12, "time_period").sortWithinPartitions("time_period").write.parquet(str(tmp_path / "usage"))
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    usage = spark.read.parquet(str(tmp_path / "usage"))
    window = calendar.pin(work.grid.orderBy("snapshot_t").limit(20).orderBy(F.desc("snapshot_t")).limit(1))
    df = usage_ops.window_range_join(usage, window, work.cfg)
    found = df.collect()
    wanted = work.tables.usage.join(window, F.col("time_period").between(F.col("window_start"), F.col("snapshot_t"))).count()
    scans = [n for n in _nodes(df) if n.nodeName().startswith("Scan parquet")]
    read = sum(n.metrics().apply("numOutputRows").value() for n in scans)
    assert len(found) == wanted
    assert wanted <= read and (kind == "timestamp_ntz" or read < usage.count() / 4)


def test_only_the_folders_of_the_days_in_question_are_read(spark, work):
    def folders(df):
        df.collect()
        return max(n.metrics().apply("numPartitions").value() for n in _nodes(df)
                   if n.nodeName().startswith("Scan parquet") and n.metrics().contains("numPartitions"))

    p = work.panel
    three = calendar.recent(p.grid, 3).select("snapshot_t")
    assert folders(calendar.on_days(p.usage_long, "snapshot_t", three)) == 3
    assert folders(p.training_usage) == calendar.training_snapshots(p.grid).count()
    assert folders(live_usage(p.usage_long, p.grid)) == 1
    assert p.usage_long.select("snapshot_t").distinct().count() > 70


def test_panel_frame_lays_rows_out_by_key_once_and_by_user_once(spark, work):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(work.frame())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_key = re.findall(r"Exchange hashpartitioning\(user_id#\d+L, snapshot_t#\d+, \d+\)", plan)
    by_user = re.findall(r"Exchange hashpartitioning\(user_id#\d+L, \d+\)", plan)
    assert len(by_key) == 2 and len(by_user) == 2 and plan.count("Exchange hashpartitioning") == 4


def _nodes(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, pending = [], [plan]
    while pending:
        node = pending.pop()
        found.append(node)
        if "QueryStage" in node.getClass().getSimpleName():
            pending.append(node.plan())
        children = node.children()
        pending += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("build", [
    lambda w: metrics.ranking_metrics(w.surrogate_scores()),
    lambda w: fold_of_user(w.at_risk(), 5, 42),
    lambda w: permute_labels(w.at_risk(), 42),
])
def test_ordered_windows_over_rows_are_bucketed(build, work):
    """Only windows over bucket or stratum totals may run in one partition."""
    for line in plan_of(build(work)).splitlines():
        if re.search(r"\bWindow \[", line) and ("row_number" in line or "_cp" in line or "_cn" in line):
            assert "_bucket" in line, line


# --- one hot key --------------------------------------------------------------

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_skew_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


T = D(2024, 4, 30)
N = 60_000


def hot(column="id"):
    """A third of the rows under key 0, the rest spread over 500 keys."""
    return F.when(F.col(column) % 3 == 0, 0).otherwise(F.col(column) % 500)


def grid(spark):
    return spark.createDataFrame([(T, T - dt.timedelta(29), D(2024, 5, 30), True, True)], calendar.GRID_SCHEMA)


def test_hot_account_is_split(spark, small_skew_limits):
    people = spark.range(0, N, 1, 8).select(
        F.concat(F.md5(F.col("id").cast("string")), F.lit("")).alias("user_id"), hot().alias("acct_id"),
        F.lit(T).alias("score_date"), F.lit("Core").alias("user_category_persona"),
    )
    state = spark.range(0, 500, 1, 2).select(
        F.col("id").alias("acct_id"), F.lit(T).alias("date"), (F.col("id") % 2 == 0).alias("paid")
    )
    state = state.union(state)
    seg = population.segment_at_snapshot(people, state, calendar.segment_days(grid(spark)))
    counts = {r.customer_segment: r.n for r in seg.groupBy("customer_segment").agg(F.count("*").alias("n")).collect()}
    want = people.groupBy((F.col("acct_id") % 2 == 0).alias("p")).count().collect()
    assert counts == {("Paid" if r.p else "Other"): r["count"] for r in want}
    seg.collect()
    assert "skew=true" in plan_of(seg)


def test_hot_user_is_split_when_flagged_users_leave(spark, small_skew_limits):
    rows = spark.range(0, N, 1, 8).select(
        hot().alias("user_id"), F.md5(F.col("id").cast("string")).alias("payload"),
        (F.col("id") % 500 == 7).alias("is_test_a"), F.lit(None).cast("boolean").alias("is_test_b"),
    )
    kept = population.exclude_flagged_users(rows, ("is_test_a", "is_test_b"))
    flagged = {r[0] for r in rows.filter("is_test_a").select("user_id").distinct().collect()}
    got = {r.user_id for r in kept.select("user_id").distinct().collect()}
    assert flagged and got == {r[0] for r in rows.select("user_id").distinct().collect()} - flagged
    kept = population.exclude_flagged_users(rows.filter("user_id <> 0 or not is_test_a"), ("is_test_a", "is_test_b"))
    assert kept.filter("user_id = 0").count() > 0
    kept.collect()
    assert "skew=true" in plan_of(kept)


def test_hot_feature_is_split_when_the_catalog_is_not_broadcast(spark, small_skew_limits):
    facts = spark.range(0, N, 1, 8).select(
        F.md5(F.col("id").cast("string")).alias("user_id"), F.lit(T).alias("time_period"),
        F.lit("A").alias("product"), F.lit("f").alias("feature"),
        hot().cast("string").alias("sub_feature"), F.lit(2).cast("bigint").alias("event_count"),
    )
    catalog = spark.range(0, 500, 1, 2).select(
        F.lit("A").alias("product"), F.lit("f").alias("feature"),
        F.col("id").cast("string").alias("sub_feature"), F.lit(True).alias("is_counted"),
    )
    out = usage_ops.windowed_usage(facts, grid(spark), catalog.union(catalog), PanelConfig(products=("A",)))
    assert tuple(out.agg(F.count("*"), F.sum("early_events"), F.max("early_active_days")).first()) == (N, 4 * N, 1)
    out.collect()
    assert "skew=true" in plan_of(out)


def test_hot_user_and_hot_day_collapse_before_the_shuffle(spark):
    """A third of the tier rows are copies of one user's row; one row per task is shuffled."""
    people = spark.range(0, N, 1, 8).select(
        hot().alias("user_id"), F.lit("a").alias("acct_id"), F.lit(T).alias("score_date"),
        F.lit("Core").alias("user_category_persona"), F.lit(False).alias("is_test_a"), F.lit(False).alias("is_test_b"),
    )
    tiers = population.tiers_by_role(people, grid(spark))
    assert tiers.count() == 500
    tiers.collect()
    shuffles = [n for n in _nodes(tiers) if n.nodeName() == "Exchange"]
    assert sum(n.metrics().apply("shuffleRecordsWritten").value() for n in shuffles) <= 8 * 500
