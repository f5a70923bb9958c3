import datetime as dt
from dataclasses import replace

import pytest

from tiercast import PanelConfig
from tiercast.operators import calendar, clean, population

D = dt.date
T, START, CHECK = D(2024, 4, 30), D(2024, 4, 1), D(2024, 5, 30)
CFG = PanelConfig(restrict_segment=None, training_months=None)
PERSONA = (
    "user_id string, acct_id string, score_date string, user_category_persona string, "
    "is_test_a boolean, is_test_b boolean"
)


def grid(spark, is_training=True, is_live=False):
    return spark.createDataFrame([(T, START, CHECK, is_training, is_live)], calendar.GRID_SCHEMA)


def personas(spark, *rows):
    full = [(*r, *[False] * (6 - len(r))) for r in rows]
    return spark.createDataFrame(full, PERSONA)


def frame(spark, rows, cfg=CFG, segments=None):
    out = population.panel_frame(personas(spark, *rows), grid(spark), segments, cfg)
    return {r.user_id: r for r in out.collect()}


def history(user, tier="Casual", joined="2024-01-01", check=None):
    rows = [(user, "a", joined, "New"), (user, "a", str(T), tier)]
    return rows + ([(user, "a", str(CHECK), check)] if check else [])


def test_label_and_missing_check_row(spark):
    got = frame(spark, history("up", check="Power User") + history("same", check="Core") + history("gone"))
    assert (got["up"].engaged, got["same"].engaged, got["gone"].engaged) == (1, 0, 0)
    assert (got["same"].check_observed, got["gone"].check_observed) == (True, False)


def test_tiers_outside_the_population(spark):
    rows = [r for t in ("New", "Casual", "Core", "Inactive", "Power User", "Elite Power User", None) for r in history(str(t), t)]
    got = frame(spark, rows)
    assert {u for u, r in got.items() if r.at_risk} == {"New", "Casual", "Core"}
    assert got["None"].persona_at_t is None and got["None"].at_risk is False


def test_full_feature_window_needed(spark):
    got = frame(spark, history("in", joined="2024-04-01") + history("out", joined="2024-04-02"))
    assert (got["in"].at_risk, got["out"].at_risk) == (True, False)


def test_cohort(spark):
    cfg = replace(CFG, joined_since=D(2024, 2, 1))
    got = frame(spark, history("old") + history("new", joined="2024-02-01"), cfg)
    assert (got["old"].at_risk, got["new"].at_risk) == (False, True)


def test_user_flagged_once_leaves_everywhere(spark):
    rows = history("ok") + history("flagged") + [("flagged", "a", "2023-06-01", "New", None, True)]
    assert set(frame(spark, rows)) == {"ok"}
    table = personas(spark, *rows)
    assert {r.user_id for r in population.exclude_flagged_users(table, CFG.flag_columns).collect()} == {"ok"}
    assert tuple(population.exclusion_counts(table, CFG.flag_columns).first()) == (2, 1, 1)


def test_unreadable_dates_are_dropped(spark):
    got = frame(spark, history("u") + [("u", "a", "2024-13-01", "New"), ("v", "a", None, "Core")])
    assert set(got) == {"u"} and got["u"].joined == D(2024, 1, 1)


def test_first_of_several_rows_on_a_day(spark):
    rows = history("u") + [("u", "0", str(T), "Core"), ("u", "0", str(T), "Elite Power User")]
    assert frame(spark, rows)["u"].persona_at_t == "Core"
    firsts = clean.dedup_first(personas(spark, *rows), ["user_id", "score_date"], ["acct_id", "user_category_persona"])
    assert {r.user_category_persona for r in firsts.collect()} == {"New", "Core"}


def test_two_accounts_one_paid(spark):
    people = personas(spark, *[("u", a, str(T), "Core") for a in "ab"], ("v", "b", str(T), "Core"), ("w", None, str(T), "Core"), ("x", "c", str(T), "Core"))
    state = spark.createDataFrame(
        [("a", T, True), ("b", T, False), ("b", T, None), ("a", CHECK, False)], "acct_id string, date date, paid boolean"
    )
    days = calendar.segment_days(grid(spark))
    seg = population.segment_at_snapshot(people, state, days)
    assert {r.user_id: r.customer_segment for r in seg.collect()} == {"u": "Paid", "v": "Other"}
    assert tuple(population.segment_coverage(people, seg, days).first()) == (2, 3)

    cfg = replace(CFG, restrict_segment="Paid")
    rows = [("u", "a", "2024-01-01", "New"), ("v", "b", "2024-01-01", "New")]
    both = people.unionByName(personas(spark, *rows))
    out = population.panel_frame(both, grid(spark), seg, cfg)
    assert {r.user_id: r.at_risk for r in out.filter("user_id in ('u', 'v')").collect()} == {"u": True, "v": False}


def test_missing_segments_raise_when_training_and_are_skipped_when_live(spark):
    cfg = replace(CFG, restrict_segment="Paid")
    people = personas(spark, *history("u"))
    with pytest.raises(ValueError, match="segment"):
        population.panel_frame(people, grid(spark), None, cfg)
    live = population.live_population(people, grid(spark, False, True), None, cfg)
    assert [r.at_risk for r in live.collect()] == [True]
    assert "engaged" not in live.columns
