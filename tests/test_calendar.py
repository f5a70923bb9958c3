import datetime as dt
import json

import pytest

from tiercast import PanelConfig
from tiercast.operators import calendar
from tiercast.sources import metadata

D = dt.date
CFG = PanelConfig(products=("A",))


def horizon(spark, first, last, events=None):
    usage = spark.createDataFrame(
        [("A", events or last), ("other", D(2030, 1, 1))], "product string, time_period date"
    )
    personas = spark.createDataFrame([(str(first),), (str(last),), ("2024-13-01",)], "score_date string")
    return calendar.data_horizon(usage, personas, CFG)


def grid(spark, *args, **kwargs):
    return calendar.snapshot_grid(horizon(spark, *args, **kwargs), CFG)


def test_horizon_takes_the_earlier_end_and_ignores_other_products(spark):
    row = horizon(spark, D(2024, 1, 5), D(2024, 5, 10), events=D(2024, 5, 20)).first()
    assert (row.event_max, row.persona_max, row.data_max) == (D(2024, 5, 20), D(2024, 5, 10), D(2024, 5, 10))
    assert row.is_stale
    assert not horizon(spark, D(2024, 1, 5), D(2024, 5, 10)).first().is_stale


def test_month_ends_include_both_ends(spark):
    rows = grid(spark, D(2024, 1, 31), D(2024, 4, 30)).orderBy("snapshot_t").collect()
    assert [r.snapshot_t for r in rows] == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]
    assert rows[1].window_start == D(2024, 1, 31)
    assert rows[1].check_day == D(2024, 3, 30)
    assert [r.is_training for r in rows] == [True, True, True, False]
    assert [r.is_live for r in rows] == [False, False, False, True]


def test_live_snapshot_can_be_a_training_snapshot(spark):
    live = calendar.live_snapshot(grid(spark, D(2024, 1, 1), D(2024, 7, 30))).first()
    assert (live.snapshot_t, live.is_training) == (D(2024, 6, 30), True)


def test_no_complete_month_is_an_error(spark):
    with pytest.raises(ValueError, match="no complete month"):
        calendar.pin(grid(spark, D(2024, 1, 5), D(2024, 1, 20)))


def test_recent_keeps_the_newest_training_snapshots(spark):
    pinned = calendar.pin(grid(spark, D(2023, 1, 1), D(2024, 1, 15)))
    newest = {r.snapshot_t for r in calendar.recent(pinned, 2).collect()}
    assert newest == {D(2023, 10, 31), D(2023, 11, 30)}
    assert calendar.recent(pinned, None).count() == 11


def test_windows_of_the_label_never_reach_the_features(spark):
    for r in grid(spark, D(2020, 1, 1), D(2024, 12, 31)).collect():
        assert r.check_day - dt.timedelta(days=CFG.window_days - 1) > r.snapshot_t


def test_leaky_buffer_is_refused():
    with pytest.raises(ValueError, match="leaks"):
        PanelConfig(window_days=30, buffer_days=28)


def test_metadata_round_trip(spark, tmp_path):
    h = horizon(spark, D(2024, 1, 5), D(2024, 5, 31))
    g = calendar.pin(calendar.snapshot_grid(h, CFG))
    path = str(tmp_path / "meta")
    metadata.write_metadata(metadata.run_metadata(g, h, CFG), path)
    read = metadata.read_metadata(spark, path)
    row = read.first()
    assert (row.live_snapshot_t, row.window_days, row.outcome_buffer_days) == ("2024-05-31", 30, 29)
    assert row.snapshots[0].T == "2024-01-31" and row.snapshots[0].feature_window_start == "2024-01-02"
    again = metadata.grid_from_metadata(read)
    kept = g.filter("is_training or is_live")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept.collect()))
    files = list((tmp_path / "meta").glob("part-*.json"))
    assert len(files) == 1 and json.loads(files[0].read_text())["persona_snapshot_is_stale"] is False


def test_missing_metadata_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build the calendar first"):
        metadata.read_metadata(spark, str(tmp_path / "none"))


def test_stale_metadata_warns(spark, tmp_path):
    h = horizon(spark, D(2024, 1, 5), D(2024, 5, 31), events=D(2024, 6, 30))
    path = str(tmp_path / "meta")
    metadata.write_metadata(metadata.run_metadata(calendar.snapshot_grid(h, CFG), h, CFG), path)
    with pytest.warns(UserWarning, match="tier history ends on 2024-05-31"):
        metadata.read_metadata(spark, path)
