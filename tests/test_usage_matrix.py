import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tiercast import PanelConfig
from tiercast.functions.columns import sanitize_name, sanitize_text
from tiercast.operators import calendar, matrix, usage

D = dt.date
CFG = PanelConfig(products=("A",), denied_features=("no",), denied_prefix="Auto")
USAGE = "user_id string, time_period date, product string, feature string, sub_feature string, event_count bigint"
CATALOG = "product string, feature string, sub_feature string, is_counted boolean"


def month_grid(spark, *ends):
    rows = [(t, t - dt.timedelta(29), t + dt.timedelta(30), True, False) for t in ends]
    return spark.createDataFrame(rows, calendar.GRID_SCHEMA)


def events(spark, *rows):
    return spark.createDataFrame([("u", d, "A", "f", s, n) for d, s, n in rows], USAGE)


def catalog(spark, *rows):
    return spark.createDataFrame([("A", "f", s, c) for s, c in rows], CATALOG)


def windowed(spark, ev, cat, cfg=CFG):
    out = usage.windowed_usage(ev, month_grid(spark, D(2023, 1, 31), D(2023, 2, 28), D(2023, 3, 31)), cat, cfg)
    return {(r.sub_feature, r.snapshot_t.month): (r.early_events, r.early_active_days) for r in out.collect()}


def test_month_edges(spark):
    """Day 1 of a 31-day month is in no window; days before a short February are in two."""
    ev = events(spark, *[(D(2023, 1, d), f"d{d}", 1) for d in (1, 2, 29, 30, 31)])
    got = set(windowed(spark, ev, catalog(spark, *[(f"d{d}", True) for d in (1, 2, 29, 30, 31)])))
    assert got == {("d2", 1), ("d29", 1), ("d30", 1), ("d30", 2), ("d31", 1), ("d31", 2)}


def test_sums_and_active_days(spark):
    ev = events(spark, (D(2023, 1, 5), "a", 2), (D(2023, 1, 5), "a", 3), (D(2023, 1, 6), "a", 1))
    assert windowed(spark, ev, catalog(spark, ("a", True))) == {("a", 1): (6, 2)}


def test_active_days_without_the_bit_mask(spark):
    ev = events(spark, (D(2023, 1, 5), "a", 2), (D(2023, 1, 5), "a", 3), (D(2023, 1, 6), "a", 1))
    stamped = ev.withColumn("time_period", F.col("time_period").cast("timestamp"))
    assert windowed(spark, stamped, catalog(spark, ("a", True))) == {("a", 1): (6, 2)}


def test_catalog_flags_and_repeated_keys(spark):
    ev = events(spark, *[(D(2023, 1, 5), s, 2) for s in ("yes", "null", "false", "twice", "absent")])
    cat = catalog(spark, ("yes", True), ("null", None), ("false", False), ("twice", True), ("twice", True))
    assert windowed(spark, ev, cat) == {("yes", 1): (2, 1), ("twice", 1): (4, 1)}
    once = windowed(spark, ev, cat, replace(CFG, dedupe_catalog=True))
    assert once == {("yes", 1): (2, 1), ("twice", 1): (2, 1)}


def test_scope_and_missing_names(spark):
    ev = events(spark, *[(D(2023, 1, 5), s, 1) for s in (None, "", "no", "Auto x", "ok")])
    cat = catalog(spark, *[(s, True) for s in (None, "no", "Auto x", "ok")])
    assert set(windowed(spark, ev, cat)) == {("", 1), ("ok", 1)}
    everything = replace(CFG, denied_prefix=None)
    assert set(windowed(spark, ev, cat, everything)) == {(None, 1), ("", 1), ("Auto x", 1), ("ok", 1)}
    denied = usage.denied_table(spark, CFG)
    assert {r.sub_feature for r in usage.drop_denied(ev, denied).collect()} == {None, "", "Auto x", "ok"}


@pytest.mark.parametrize("width", [1, 7, 30, 31, 45, 90])
def test_range_join_equals_brute_force_on_irregular_windows(spark, width):
    ends = [D(2023, 1, 31), D(2023, 2, 3), D(2023, 2, 4), D(2023, 4, 30), D(2023, 9, 1)]
    days = [D(2022, 11, 1) + dt.timedelta(i) for i in range(400)]
    grid = spark.createDataFrame(
        [(t, t - dt.timedelta(width - 1)) for t in ends], "snapshot_t date, window_start date"
    )
    cfg = PanelConfig(window_days=width, buffer_days=width)
    got = usage.window_range_join(events(spark, *[(d, "a", 1) for d in days]), grid, cfg)
    want = {(d, t) for d in days for t in ends if t - dt.timedelta(width - 1) <= d <= t}
    pairs = [(r.time_period, r.snapshot_t) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_names(spark):
    raw = ["a[b", "a<b", " x]  ", "  ", "", " y\t", "plain"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(raw)], "i int, s string")
    got = [r.n for r in rows.select("i", sanitize_name(F.col("s")).alias("n")).orderBy("i").collect()]
    assert got == ["a_b", "a_b", "x_", "(unlabeled)", "(unlabeled)", "y", "plain"]
    assert got == [sanitize_text(s) for s in raw]


T1 = D(2023, 1, 31)
LONG = "user_id string, snapshot_t date, sub_feature string, early_events bigint"


def keys(spark, *users):
    return spark.createDataFrame([(u, T1, i % 2) for i, u in enumerate(users)], "user_id string, snapshot_t date, engaged int")


def long_usage(spark, *rows):
    return spark.createDataFrame([(u, T1, s, n) for u, s, n in rows], LONG)


def test_matrix_keeps_rows_without_usage_and_adds_up_colliding_names(spark):
    at_risk, use = keys(spark, "u", "v"), long_usage(spark, ("u", "a[b", 2), ("u", "a<b", 3), ("u", "c.d`e", 1), ("x", "c", 9))
    names = matrix.feature_names(matrix.feature_list(matrix.at_risk_usage(use, at_risk)))
    assert names == ["a_b", "c.d`e"]
    wide = matrix.feature_matrix(at_risk, use, names)
    assert wide.columns == ["user_id", "snapshot_t", "engaged", "a_b", "c.d`e"]
    assert {r[0]: tuple(r[2:]) for r in wide.collect()} == {"u": (0, 5, 1), "v": (1, 0, 0)}
    logged = {r[0]: r[3] for r in matrix.log_features(wide, names).collect()}
    assert logged["u"] == pytest.approx(1.791759469228055) and logged["v"] == 0
    sparse = matrix.sparse_matrix(at_risk, use, matrix.feature_list(matrix.at_risk_usage(use, at_risk)))
    assert {r[0]: (r.indices, r.values) for r in sparse.select("user_id", "indices", F.col("values").alias("values")).collect()}["v"][0] == []


def test_alignment_to_a_trained_list(spark):
    at_risk, use = keys(spark, "u"), long_usage(spark, ("u", "new", 7), ("u", "b", 2))
    trained = matrix.feature_table(spark, ["b", "gone"])
    present = matrix.feature_list(matrix.at_risk_usage(use, at_risk))
    assert [r.sub_feature for r in matrix.unseen_features(present, trained).collect()] == ["new"]
    aligned = {r.sub_feature: r.is_present for r in matrix.align_features(present, trained).collect()}
    assert aligned == {"b": True, "gone": False}
    assert tuple(matrix.feature_matrix(at_risk, use, ["b", "gone"]).first())[3:] == (2, 0)


def test_excluded_features_compare_after_sanitising(spark):
    use = long_usage(spark, ("u", "a[b", 1), ("u", "c", 1))
    listed = matrix.feature_list(use)
    kept = matrix.model_features(listed, replace(CFG, exclude_features=("a<b",)))
    assert [tuple(r) for r in kept.collect()] == [(0, "c")]
    assert listed.count() == 2


def test_sparse_rows_hold_the_logged_matrix(spark):
    at_risk = keys(spark, "u", "v", "w")
    use = long_usage(spark, ("u", "a[b", 2), ("u", "a<b", 3), ("u", "c", 1), ("u", "z", 4), ("w", "c", 0), ("x", "c", 9), ("v", None, 5))
    features = matrix.feature_table(spark, ["a_b", "c", "never"])
    got = {r.user_id: r for r in matrix.sparse_rows(at_risk, use, features, 3).collect()}
    assert (got["u"].engaged, got["u"].x.size, got["u"].x.indices) == (0, 3, [0, 1])
    assert got["u"].x["values"] == pytest.approx([1.791759469228055, 0.6931471805599453])
    assert got["v"].x.indices == got["w"].x.indices == []
    assert matrix.sparse_rows(at_risk.limit(0), use, features, 3).count() == 0


def test_a_list_beyond_any_column_limit_keeps_every_feature(spark):
    use = spark.range(20_000).select(
        F.format_string("u%d", F.col("id") % 50).alias("user_id"), F.lit(T1).alias("snapshot_t"),
        F.format_string("f%05d", "id").alias("sub_feature"), (F.col("id") + 1).alias("early_events"))
    names = matrix.feature_names(matrix.feature_list(use))
    assert len(names) == 20_000
    rows = matrix.sparse_rows(keys(spark, *[f"u{i}" for i in range(50)]), use, matrix.feature_table(spark, names), len(names))
    cells = rows.select(F.explode(F.arrays_zip("x.indices", "x.values")).alias("c")).select("c.*").collect()
    assert len(cells) == 20_000 and {r[0] for r in cells} == set(range(20_000))
    assert all(abs(r[1] - math.log1p(r[0] + 1)) < 1e-12 for r in cells)
