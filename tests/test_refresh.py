"""A run to one month, a month of facts more, and the month scored by the older model."""

import datetime as dt
import glob
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tiercast import ModelParams
from tiercast.operators import boosting, calendar, population
from tiercast.plans import refresh
from tiercast.plans.live import forecast
from tiercast.plans.panel import build_panel
from tiercast.plans.run import (
    PanelTables, plan_calendar, prepare_run, read_facts, read_personas, read_tier_days, run_panel, score_month,
)
from tiercast.plans.training import TrainingRun
from tiercast.sources import metadata, sinks

LAST = dt.date(2001, 6, 5)  # the tables go on to August


def cut(tables, day):
    return PanelTables(
        tables.usage.filter(F.col("time_period") <= F.lit(day)), tables.catalog,
        tables.personas.filter(F.col("score_date") <= F.lit(day)), tables.account_state.filter(F.col("date") <= F.lit(day)))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def files(out):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/*/*/part-*")}


def tier_file(path):
    return path.split("/")[-3] in ("personas", "user_facts", "tier_days")


@pytest.fixture(scope="module")
def whole(work):
    t = work.tables
    return PanelTables(t.usage, t.catalog, t.personas, t.account_state)


@pytest.fixture(scope="module")
def scored(spark, work, whole, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("older"))
    cfg = replace(work.cfg, model=ModelParams(trees=3))
    panel, _ = prepare_run(spark, cut(whole, LAST), cfg, out)
    boosting.save_model(TrainingRun(panel, cfg).final_model, panel.names, f"{out}/model")
    before, old = files(out), metadata.read_metadata(spark, f"{out}/metadata").first()
    live = refresh.score_new_month(spark, out, whole, cfg, f"{out}/scored")
    return out, cfg, before, old, live


def test_the_run_knew_less(scored):
    _, _, _, old, live = scored
    assert old.data_max_date <= str(LAST) and old.live_snapshot_t == "2001-05-31"
    assert str(live.summary.first().snapshot_t) == "2001-07-31"


def test_equal_to_a_full_rebuild(spark, scored, whole):
    out, cfg, _, _, live = scored
    horizon, grid = plan_calendar(whole, cfg)
    panel = build_panel(grid, whole.personas, whole.usage, whole.catalog, whole.account_state, cfg)
    same(spark.read.parquet(f"{out}/usage_long"), panel.usage_long)
    same(sinks.read_segments(spark, f"{out}/segments"), panel.segments)
    same(read_personas(spark, out), whole.personas)
    saved = metadata.read_metadata(spark, f"{out}/metadata")
    assert saved.collect() == metadata.run_metadata(grid, horizon, cfg).select(*saved.columns).collect()
    model, names = boosting.load_model(spark, f"{out}/model")
    again = forecast(model, names, whole.personas, panel.usage_long, panel.segments, grid, cfg)
    rounded = F.round("forecast_probability", 12).alias("p")
    assert live.scores.count() > 0
    same(live.scores.select("user_id", "snapshot_t", rounded), again.scores.select("user_id", "snapshot_t", rounded))
    same(live.unseen, again.unseen)
    assert live.ranking.collect() == again.ranking.collect()


def test_old_folders_are_not_written_again(scored):
    out, _, before, _, _ = scored
    after = files(out)
    last = ("tier_month=2001-05", "tier_month=__HIVE", "tier_day=2001-05")  # the month of the last saved tier day is replaced
    kept = {p for p in before if not any(folder in p for folder in last)}
    assert len(kept) > 100 and all(after.get(p) == before[p] for p in kept)
    added = {p.split("/")[-2] for p in after if p not in before and "/usage_long/" in p}
    assert added == {"snapshot_t=2001-06-30", "snapshot_t=2001-07-31"}


def test_the_new_windows_alone_are_read(scored, work, whole):
    _, cfg, _, old, _ = scored
    _, grid = plan_calendar(whole, cfg)
    fresh = refresh.new_snapshots(grid, dt.date.fromisoformat(old.data_max_date))
    assert sorted(str(r.snapshot_t) for r in fresh.collect()) == ["2001-06-30", "2001-07-31"]
    late = refresh.new_snapshots(grid, dt.date.fromisoformat(old.data_max_date), dt.date(2001, 4, 30))
    assert min(str(r.snapshot_t) for r in late.collect()) == "2001-04-30"


def test_features_the_model_never_saw(spark, scored, whole):
    """A sub-feature first used in the new month is reported, not scored."""
    out, cfg, _, _, live = scored
    some = live.scores.first().user_id
    novel = spark.createDataFrame(
        [(some, dt.date(2001, 7, 20), "Alpha", "1-URGENT", "BRAND NEW", 4)], whole.usage.schema)
    known = spark.createDataFrame([("Alpha", "1-URGENT", "BRAND NEW", True)], whole.catalog.schema)
    more = PanelTables(whole.usage.unionByName(novel), whole.catalog.unionByName(known), whole.personas, whole.account_state)
    again = refresh.score_new_month(spark, out, more, cfg, f"{out}/late", again_from=dt.date(2001, 7, 31))
    assert "BRAND NEW" in {r.sub_feature for r in again.unseen.collect()}
    same(again.scores, live.scores)


def test_repeating_a_refresh_changes_nothing(spark, scored, whole):
    out, cfg, _, _, _ = scored
    refresh.add_months(spark, out, whole, cfg, again_from=dt.date(2001, 7, 1))
    usage, tiers = spark.read.parquet(f"{out}/usage_long").count(), read_personas(spark, out).count()
    live = score_month(spark, out, cfg, f"{out}/once-more")
    before = files(out)
    grid = refresh.add_months(spark, out, whole, cfg)
    assert usage == spark.read.parquet(f"{out}/usage_long").count() and tiers == read_personas(spark, out).count() == whole.personas.count()
    assert {p for p in files(out) if p not in before and not tier_file(p)} == set()
    assert calendar.live_snapshot(grid).first().snapshot_t == live.summary.first().snapshot_t


def test_facts_and_grid_days_equal_those_of_the_whole_history(spark, scored, whole):
    out, cfg, _, _, _ = scored
    _, grid = plan_calendar(whole, cfg)
    same(read_facts(spark, out), population.user_facts(whole.personas, cfg.flag_columns))
    same(read_tier_days(spark, out), population.rows_on_grid(whole.personas, grid))


def test_facts_of_halves_merge_to_the_whole(whole, work):
    flags = work.cfg.flag_columns
    day = F.col("score_date")
    early = population.user_facts(whole.personas.filter(day <= F.lit(LAST)), flags)
    late = population.user_facts(whole.personas.filter(day > F.lit(LAST)), flags)
    merged = population.merged_facts(early.unionByName(late).unionByName(early))
    same(merged, population.user_facts(whole.personas, flags))


def test_a_run_reads_the_tier_history_once(spark, whole, work, tmp_path):
    """Every row of the source leaves its scan exactly once, training, forecast and report included."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    tables = replace(whole, personas=whole.personas.mapInArrow(counted, whole.personas.schema))
    run_panel(spark, tables, replace(work.cfg, model=ModelParams(trees=1)), str(tmp_path)).count()
    assert seen.value == whole.personas.count()


def test_last_event_day_from_newer_facts_alone(whole, work):
    last = calendar.last_event(whole.usage, work.cfg).first().event_max
    assert calendar.last_event(whole.usage, work.cfg, known=LAST).first().event_max == last
    assert calendar.last_event(whole.usage, work.cfg, known=last).first().event_max == last
    assert calendar.last_event(whole.usage.limit(0), work.cfg, known=LAST).first().event_max == LAST


def test_other_windows_are_refused(spark, scored, whole):
    out, cfg, _, _, _ = scored
    with pytest.raises(ValueError, match="window_days=30"):
        refresh.add_months(spark, out, whole, replace(cfg, window_days=7))
    with pytest.raises(FileNotFoundError):
        refresh.score_new_month(spark, f"{out}/nowhere", whole, cfg, f"{out}/x")
