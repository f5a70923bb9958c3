"""Work that grows with users stays off the driver, and fits have a bounded number of tasks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tiercast.config import PanelConfig
from tiercast.operators import boosting, importance, matrix, population, ranks, splits
from tiercast.plans.panel import nonzero_values
from tiercast.sources.testdata import personas

DAY = dt.date(2024, 1, 31)


@pytest.fixture
def broadcasts(spark, tmp_path):
    """Counts the broadcasts of a frame whose inputs are small files, under Spark's own threshold."""

    def count(build, *frames):
        kept = []
        for i, df in enumerate(frames):
            df.write.parquet(f"{tmp_path}/{i}")
            kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        out = build(*kept)
        out.collect()
        return out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")

    return count


def _users(spark, n=50):
    return spark.range(n).select(F.col("id").alias("user_id"), F.lit(DAY).alias("snapshot_t"))


def test_states_of_accounts_are_not_broadcast(spark, broadcasts):
    personas = _users(spark).select("user_id", F.col("user_id").alias("acct_id"), F.lit(DAY).alias("score_date"))
    state = _users(spark).select(F.col("user_id").alias("acct_id"), F.lit(DAY).alias("date"), F.lit(True).alias("paid"))
    days = spark.createDataFrame([(DAY,)], "snapshot_t date")
    assert broadcasts(lambda p, s: population.segment_at_snapshot(p, s, days), personas, state) == 0


def test_rows_at_risk_and_folds_are_not_broadcast(spark, broadcasts):
    rows = _users(spark).withColumn("engaged", (F.col("user_id") % 2).cast("int"))
    usage = _users(spark).select("*", F.lit("f").alias("sub_feature"), F.lit(1).cast("bigint").alias("early_events"))
    assert broadcasts(matrix.at_risk_usage, usage, rows) == 0
    spread = splits.group_folds(rows, 5, 42)
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


@pytest.mark.parametrize("within", [[], ["group"]])
def test_offsets_of_buckets_are_not_broadcast(spark, broadcasts, within):
    """There are more of them with every user, up to all buckets of every group."""
    users = _users(spark).select("user_id", (F.col("user_id") % 3).alias("group"), (F.col("user_id") * 2**26).alias("h"))
    assert broadcasts(lambda u: ranks.rank_by_hash(u, "h", ["user_id"], "n", within), users) == 0


def test_rows_are_not_broadcast_to_their_values(spark, broadcasts):
    usage = _users(spark).select("*", F.lit("f").alias("sub_feature"), F.lit(1).cast("bigint").alias("early_events"))
    assert broadcasts(nonzero_values, usage, _users(spark)) == 0


def test_cells_of_the_table_per_row_are_not_broadcast(spark, broadcasts):
    scored = _users(spark).select("*", F.lit(1).alias("engaged"), F.lit(0.5).alias("score"))
    phi = _users(spark).select("*", F.lit("f").alias("sub_feature"), F.lit(1.0).alias("phi"))
    assert broadcasts(lambda s, p: importance.per_row(s, p, ["f"]), scored, phi) == 0


def test_cells_meet_the_mean_of_their_feature_where_they_are(spark):
    """A shuffle by feature would send all cells of a feature to one task."""
    phi = _users(spark).select("*", F.lit("f").alias("sub_feature"), F.lit(1.0).alias("value"), F.col("user_id").cast("double").alias("phi"))
    out = importance.direction(
        phi, phi.select("sub_feature", "value"), _users(spark), spark.createDataFrame([(0, "f")], "idx int, sub_feature string"))
    assert "rightHint=(strategy=broadcast)" in out._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_a_fit_end_somewhere():
    cfg = PanelConfig()
    assert [boosting.tasks_of(n, cfg) for n in (0, 4_999, 12_000, 320_000)] == [1, 1, 2, 64]
    assert boosting.tasks_of(30_000_000, cfg) == boosting.MAX_TASKS


def test_days_of_the_tier_history_are_made_where_the_user_is(spark):
    """No row of the history is shuffled or sorted to meet its count; a null user's counts meet nobody."""
    usage = spark.createDataFrame(
        [(1, dt.date(2024, 1, 30), 4), (1, dt.date(2024, 3, 5), 1), (None, dt.date(2024, 1, 31), 3)],
        "user_id bigint, time_period date, event_count bigint")
    history = personas(usage)
    joins = [x for x in history._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in x]
    assert joins and not any("(d#" in x for x in joins)
    rows = {(r.user_id, f"{r.score_date:%m-%d}"): r.user_category_persona for r in history.collect()}
    assert rows == {
        (1, "01-30"): "New", (1, "01-31"): "New", (1, "02-29"): "Inactive", (1, "03-01"): "Inactive",
        (1, "03-30"): "Casual", (None, "01-31"): "Inactive", (None, "02-29"): "Inactive", (None, "03-01"): "Inactive",
        (None, "03-30"): "Inactive"}
