"""The queries of :mod:`tiercast.checks.queries` as plain SQL for DuckDB."""

from __future__ import annotations

import re

from tiercast.checks.fixed_model import values_sql

# Building blocks, in dependency order; a query takes along those it mentions.
BLOCKS = {
    "usage_daily": """
        select o_custkey as user_id, cast(o_orderdate as date) as time_period,
               case l_returnflag when 'N' then 'Alpha' when 'A' then 'Beta' else 'Gamma' end as product,
               o_orderpriority as feature,
               case when p_brand = 'Brand#25' then null else p_type || ' - ' || p_brand end as sub_feature,
               cast(count(*) as bigint) as event_count
        from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
        group by all""",
    "usage_catalog": """
        select distinct product, feature, coalesce(sub_feature, '') as sub_feature,
               case when feature = '5-LOW' then false
                    when feature = '4-NOT SPECIFIED' and product = 'Beta' then null
                    else true end as is_counted
        from usage_daily""",
    "span": "select min(time_period) as lo, max(time_period) as hi from usage_daily",
    "month_ends": """
        select t from (
            select unnest(generate_series(date_trunc('month', lo)::timestamp, hi::timestamp, interval 1 month)) as m, hi
            from span) s, lateral (select last_day(cast(m as date)) as t) l
        where t <= hi""",
    "probe_dates": "select t as d from month_ends union select t + 30 from month_ends",
    "act": "select user_id, time_period, sum(event_count) as n from usage_daily group by all",
    "first_day": "select user_id, min(time_period) as joined from act group by all",
    "tier_days": """
        select user_id, joined, d from first_day join probe_dates on joined <= d
        union select user_id, joined, joined from first_day""",
    "items": """
        select t.user_id, t.joined, t.d, coalesce(sum(n), 0) as items
        from tier_days t left join act a on t.user_id = a.user_id and a.time_period between t.d - 29 and t.d
        group by all""",
    "personas": """
        select user_id, user_id as acct_id, d as score_date,
               case when items = 0 then 'Inactive' when d < joined + 29 then 'New' when items <= 2 then 'Casual'
                    when items <= 5 then 'Core' when items <= 8 then 'Power User' else 'Elite Power User' end as tier,
               (user_id % 50 = 7 and month(d) = 1) as is_test_a, (user_id % 97 = 3) as is_test_b
        from items""",
    "account_state": """
        select acct_id, d as date, o_orderstatus <> 'F' as paid from (
            select o_custkey as acct_id, d, o_orderstatus,
                   row_number() over (partition by o_custkey, d order by o_orderdate desc, o_orderkey desc) as rn
            from orders join probe_dates on cast(o_orderdate as date) <= d where o_custkey % 11 <> 5)
        where rn = 1""",
    "horizon": """
        select event_max, persona_min, persona_max, least(event_max, persona_max) as data_max,
               persona_max < event_max as is_stale
        from (select max(time_period) as event_max from usage_daily where product in ('Alpha', 'Beta')),
             (select min(score_date) as persona_min, max(score_date) as persona_max from personas)""",
    "grid": """
        select t as snapshot_t, t - 29 as window_start, t + 30 as check_day,
               t + 30 <= data_max as is_training,
               t = max(t) over () as is_live
        from (select last_day(cast(m as date)) as t, data_max from (
            select unnest(generate_series(date_trunc('month', persona_min)::timestamp, data_max::timestamp,
                                          interval 1 month)) as m, data_max from horizon))
        where t <= data_max""",
    "segments": """
        select user_id, snapshot_t, case when bool_or(coalesce(paid, false)) then 'Paid' else 'Other' end as customer_segment
        from personas p join grid on p.score_date = snapshot_t and (is_training or is_live)
             join account_state s on p.acct_id = s.acct_id and s.date = snapshot_t
        group by all""",
    "clean_users": """
        select user_id, min(score_date) as joined from personas
        group by user_id having not bool_or(is_test_a or is_test_b)""",
    "all_frames": """
        select p.user_id, grid.snapshot_t, window_start, joined, p.tier as persona_at_t, c.tier as persona_at_check,
               c.user_id is not null as check_observed, is_training, is_live,
               (p.tier not in ('Inactive', 'Power User', 'Elite Power User') and joined <= window_start
                and coalesce(customer_segment = 'Paid', false)) as at_risk,
               case when c.tier in ('Power User', 'Elite Power User') then 1 else 0 end as engaged
        from grid join personas p on p.score_date = grid.snapshot_t join clean_users u on u.user_id = p.user_id
             left join personas c on c.user_id = p.user_id and c.score_date = check_day
             left join segments g on g.user_id = p.user_id and g.snapshot_t = grid.snapshot_t""",
    "frame": """
        select user_id, snapshot_t, joined, persona_at_t, persona_at_check, check_observed, at_risk, engaged
        from all_frames where is_training""",
    "at_risk_keys": "select user_id, snapshot_t, engaged from frame where at_risk",
    "scoped": """
        select * from usage_daily where product in ('Alpha', 'Beta') and sub_feature not like 'PROMO%'""",
    "usage_long": """
        select f.user_id, snapshot_t, f.sub_feature, cast(sum(f.event_count) as bigint) as early_events,
               count(distinct f.time_period) as early_active_days
        from scoped f join grid on f.time_period between window_start and snapshot_t
             join usage_catalog k on f.product = k.product and f.feature = k.feature
              and coalesce(f.sub_feature, '') = coalesce(k.sub_feature, '')
        where k.is_counted is true and f.sub_feature not in ('SMALL - Brand#1', 'LARGE - Brand#2')
        group by all""",
    "risk_usage": "select u.* from usage_long u semi join at_risk_keys using (user_id, snapshot_t)",
    "features": """
        select cast(row_number() over (order by sub_feature) - 1 as integer) as idx, sub_feature
        from (select distinct sub_feature from risk_usage)""",
    "trained": """
        select cast(row_number() over (order by sub_feature) - 1 as integer) as idx, sub_feature
        from features where sub_feature <> 'STANDARD - Brand#1'""",
    "live_keys": "select user_id, snapshot_t from all_frames where is_live and at_risk",
    "live_usage": "select u.* from usage_long u semi join live_keys using (user_id, snapshot_t)",
    "live_features": "select distinct sub_feature from live_usage",
    "cells": """
        select user_id, snapshot_t, engaged, idx, sub_feature, coalesce(early_events, 0) as n,
               ln(1 + coalesce(early_events, 0)) as value
        from at_risk_keys cross join trained left join usage_long using (user_id, snapshot_t, sub_feature)""",
    "phi": """
        select *, (value - avg(value) over (partition by sub_feature))
                  * (case when length(sub_feature) % 2 = 0 then 1 else -1 end) as phi
        from cells""",
    "surrogate_importance": """
        select sub_feature, round(avg(abs(phi)), 12) as m, cast(count(distinct user_id) filter (where value > 0) as double) as g,
               cast(case when min(value) = max(value) then 0 else sign(covar_pop(value, phi)) end as double) as direction
        from phi group by sub_feature""",
    "surrogate_by_snapshot": """
        select snapshot_t, n_rows, rank, sub_feature, round_even(m, 3) as mean_abs_shap from (
            select snapshot_t, sub_feature, count(*) as n_rows, avg(abs(phi)) as m,
                   row_number() over (partition by snapshot_t order by round(avg(abs(phi)), 12) desc, sub_feature) as rank
            from phi group by snapshot_t, sub_feature)
        where rank <= 10""",
    "scored": """
        select user_id, snapshot_t, engaged,
               round(ln(1 + coalesce(sum(early_events), 0)) + (user_id % 7) / 10.0, 2) as score
        from at_risk_keys left join usage_long using (user_id, snapshot_t)
        group by user_id, snapshot_t, engaged""",
    "hashed_users": """
        select user_id, count(*) as n_rows, sum(engaged) as n_pos,
               cast('0x' || substr(md5(user_id || ':42'), 1, 8) as bigint) as h
        from at_risk_keys group by user_id""",
    "dealt": """
        select user_id, cast(row_number() over (order by n_rows, n_pos, h, user_id) % 5 as integer) as fold
        from hashed_users""",
    "marked": """
        select k.*, cast('0x' || substr(md5(user_id || ':42'), 1, 8) as bigint) % 10000 < 2000 as is_test
        from at_risk_keys k""",
    "pool_users": """
        select user_id, count(*) as n_rows, sum(engaged) as n_pos,
               cast('0x' || substr(md5(user_id || ':42'), 1, 8) as bigint) as h
        from marked where not is_test group by user_id""",
    "pool_dealt": """
        select user_id, cast(row_number() over (order by n_rows, n_pos, h, user_id) % 5 as integer) as fold
        from pool_users""",
    "orders_of_rows": """
        select *, row_number() over (order by substr(md5(user_id || ':' || snapshot_t || ':42-rows'), 1, 8),
                                     user_id, snapshot_t) as taker,
               row_number() over (order by substr(md5(user_id || ':' || snapshot_t || ':42-labels'), 1, 8),
                                  user_id, snapshot_t) as giver
        from at_risk_keys""",
    # a model that is written down: the steps to each leaf, what of them a row meets, and coalitions of the others
    "fixed_nodes": f"""
        select * from (values {values_sql()})
            v(fold, tree, tree_weight, node, prediction, cover, gain, low, high, feature, threshold)""",
    "fixed_steps": """
        select fold, tree, node as leaf, points, unnest(path, recursive := true) from (
            with recursive walk as (
                select *, 2.0 * tree_weight * prediction as points,
                       cast([] as struct(f integer, up boolean, t double, r double)[]) as path
                from fixed_nodes where node = 0
                union all
                select n.*, 2.0 * w.tree_weight * n.prediction,
                       list_append(w.path, {'f': w.feature, 'up': n.node = w.high, 't': w.threshold, 'r': n.cover / w.cover})
                from walk w join fixed_nodes n on n.fold = w.fold and n.tree = w.tree and n.node in (w.low, w.high)
                where w.low >= 0)
            select * from walk where low < 0)""",
    "fixed_terms": """
        select user_id, snapshot_t, engaged, s.fold, tree, leaf, points, f, value,
               cast(min(case when (value > t) = up then 1 else 0 end) as double) as held, product(r) as ratio
        from cells join fixed_steps s on s.f = cells.idx
        group by all""",
    "fixed_scores": """
        select user_id, snapshot_t, engaged, fold, 1 / (1 + exp(-sum(points))) as score from (
            select user_id, snapshot_t, engaged, fold, tree, leaf, points from fixed_terms
            group by all having min(held) = 1)
        group by all""",
    "fixed_others": """
        select a.user_id, a.snapshot_t, a.fold, a.tree, a.leaf, a.points, a.f, a.held, a.ratio,
               count(b.f) as k, coalesce(sum(b.held), 0) as h, coalesce(sum(b.ratio), 0) as r,
               coalesce(product(b.held), 1) as hh, coalesce(product(b.ratio), 1) as rr, coalesce(sum(b.held * b.ratio), 0) as hr
        from fixed_terms a join dealt on a.user_id = dealt.user_id and a.fold = dealt.fold
             left join fixed_terms b
               on a.user_id = b.user_id and a.snapshot_t = b.snapshot_t and a.fold = b.fold and a.tree = b.tree
              and a.leaf = b.leaf and a.f <> b.f
        group by all""",
    "fixed_phi": """
        select user_id, snapshot_t, f as idx, sum(points * (held - ratio) * case k
                   when 0 then 1
                   when 1 then (h + r) / 2
                   else hh / 3 + (h * r - hr) / 6 + rr / 3 end) as phi
        from fixed_others group by all""",
    "fixed_cells": """
        select user_id, snapshot_t, cells.idx, sub_feature, value, coalesce(phi, 0) as phi
        from cells left join fixed_phi using (user_id, snapshot_t, idx)""",
    "fixed_gain": """
        select sub_feature, coalesce(sum(g), 0) / 5 as gain
        from trained left join (select fold, feature, avg(gain) as g from fixed_nodes where low >= 0 group by all) on idx = feature
        group by sub_feature""",
    "fixed_ranking": """
        select sub_feature, round(avg(abs(phi)), 12) as m,
               row_number() over (order by round(avg(abs(phi)), 12) desc, sub_feature) as rank,
               cast(case when min(value) = max(value) then 0 when min(round(phi, 12)) = max(round(phi, 12)) then null
                         else sign(covar_pop(value, phi)) end as double) as direction
        from fixed_cells group by sub_feature""",
}


def _ranking_sql(by: str, scored: str = "scored") -> str:
    """Both ranking metrics from tie groups, per ``by`` column or overall."""
    keys, part = (f"{by},", f"partition by {by}") if by else ("", "")
    return f"""
        select {keys} p + n as n_rows,
               round(case when p > 0 and n > 0 then wins / (p * n) end, 6) as roc_auc,
               round(case when p > 0 then precision_sum / p end, 6) as average_precision
        from (
            select {keys} sum(n_pos) as p, sum(n_neg) as n,
                   sum(n_neg * (cum_pos - n_pos + n_pos / 2.0)) as wins,
                   sum(n_pos * cum_pos / (cum_pos + cum_neg)) as precision_sum
            from (
                select *, sum(n_pos) over (w) as cum_pos, sum(n_neg) over (w) as cum_neg
                from (select {keys} score, cast(sum(engaged) as double) as n_pos,
                             cast(sum(1 - engaged) as double) as n_neg
                      from {scored} group by {keys} score)
                window w as ({part} order by score desc))
            {f'group by {by}' if by else ''})"""


def _packed_sql(rows: str, features: str, value: str, carried: str) -> str:
    """Every row against every listed feature, its values as one text in feature order."""
    return f"""
        select {carried}, string_agg(cast({value} as varchar), ',' order by idx) as cells
        from {rows} cross join {features} left join usage_long using (user_id, snapshot_t, sub_feature)
        group by {carried}"""


_KEYS = "user_id, snapshot_t"

RAW = {
    # sources and calendar
    "ingest_personas": """
        select user_id, acct_id, score_date, tier = 'Inactive' as pre_activity,
               cast(score_date - date '1995-01-01' as integer) as day_of_journey,
               score_date - 1 as last_session_login_date, user_id % 30 as days_inactive,
               tier as user_category_persona, 'tier ' || tier as user_category_reason,
               (user_id % 64) / 64 as user_category_score,
               (user_id % 16) / 16 as user_category_percentile_compared_today,
               tier as usage_depth_persona, user_id % 5 as usage_depth,
               (user_id % 8) / 8 as usage_depth_percentile_compared_today,
               tier as login_frequency_persona, month(score_date) / 4 as login_ratio,
               1 - (user_id % 8) / 8 as login_frequency_percentile_compared_today,
               tier as feature_adoption_persona, user_id % 3 as feature_adoption_ratio,
               (user_id % 8) / 8 / 2 as feature_adoption_percentile_compared_today,
               false as is_test_a, false as is_test_b
        from personas""",
    "scan_project": "select o_orderkey, o_custkey, o_totalprice from orders",
    "data_horizon": "select * from horizon",
    "snapshot_grid": "select * from grid",
    "training_snapshots": "select * from grid where is_training",
    "live_snapshot": "select * from grid where is_live",
    "recent_snapshots": "select * from grid where is_training order by snapshot_t desc limit 4",
    "run_metadata": """
        select cast(event_max as varchar) as event_max_date, cast(persona_max as varchar) as persona_max_date,
               is_stale as persona_snapshot_is_stale, cast(data_max as varchar) as data_max_date,
               30 as window_days, 29 as outcome_buffer_days,
               (select cast(max(snapshot_t) as varchar) from grid where is_live) as live_snapshot_t,
               (select bool_or(is_live and is_training) from grid) as live_snapshot_is_training_eligible,
               (select '[' || string_agg('{"T":"' || snapshot_t || '","feature_window_start":"' || window_start
                       || '","feature_window_end":"' || snapshot_t || '","check_day":"' || check_day || '"}',
                       ',' order by snapshot_t) || ']' from grid where is_training) as snapshots
        from horizon""",
    "date_labels": "select cast(snapshot_t as varchar) as iso, strftime(snapshot_t, '%B %Y') as label from grid",
    # cleaning
    "safe_dates": """
        select * from (
            select o_orderkey, try_cast(case o_orderkey % 10 when 0 then '2024-13-01' when 1 then 'n/a'
                                        else strftime(o_orderdate, '%Y-%m-%d') end as date) as score_date
            from orders) where score_date is not null""",
    "distinct_keys": "select distinct user_id, time_period from usage_daily",
    "dedup_first": """
        select user_id, time_period, product, feature, sub_feature, event_count from (
            select *, row_number() over (partition by user_id, time_period
                order by product, feature, sub_feature nulls first, event_count) as rn
            from usage_daily) where rn = 1""",
    "sanitize_names": r"""
        select p_partkey, case when cleaned = '' then '(unlabeled)' else cleaned end as sub_feature from (
            select p_partkey, trim(regexp_replace(case p_partkey % 4 when 0 then ' [' || p_brand || '] ' when 1 then '   '
                when 2 then '<' || p_type || '>' else p_type end, '[\[\]<>]', '_', 'g')) as cleaned
            from part)""",
    # population
    "exclude_flagged_users": """
        select user_id, score_date, tier as user_category_persona from personas
        where user_id in (select user_id from clean_users)""",
    "exclusion_counts": """
        select n_before, n_before - n_after as n_excluded, n_after
        from (select count(distinct user_id) as n_before from personas), (select count(*) as n_after from clean_users)""",
    "user_join_date": "select user_id, joined from clean_users",
    "segment_at_snapshot": "select * from segments",
    "segment_counts": "select customer_segment, count(*) as n_rows from segments group by all",
    "segment_coverage": """
        select count(s.user_id) as n_matched, count(*) as n_total
        from (select distinct user_id, snapshot_t from personas
              join grid on score_date = snapshot_t and (is_training or is_live) where acct_id is not null) k
        left join segments s using (user_id, snapshot_t)""",
    "panel_frame": "select * from frame",
    "at_risk": "select * from at_risk_keys",
    "at_risk_cohort": """
        select user_id, snapshot_t from frame where at_risk and joined >= date '1997-01-01'""",
    "live_population": """
        select user_id, snapshot_t, joined, persona_at_t, at_risk from all_frames where is_live""",
    # usage
    "usage_scope": "select * from scoped",
    "denylist_anti": """
        select * from usage_daily where sub_feature is null or sub_feature not in ('SMALL - Brand#1', 'LARGE - Brand#2')""",
    "window_range_join": """
        select f.*, snapshot_t from usage_daily f join grid on time_period between window_start and snapshot_t""",
    "window_range_join_weekly": """
        select user_id, snapshot_t, event_type, count(*) as n_events
        from events join (select distinct unnest(generate_series(lo, hi, interval 1 day))::date as snapshot_t
                          from (select min(ts)::date::timestamp as lo, max(ts)::date::timestamp as hi from events))
          on ts::date between snapshot_t - 6 and snapshot_t
        group by all""",
    "windowed_usage": "select * from usage_long",
    "at_risk_usage": "select * from risk_usage",
    "run_counts": """
        select count(*) as n_rows, count(distinct sub_feature) as n_features, count(distinct user_id) as n_users,
               count(distinct snapshot_t) as n_snapshots from usage_long""",
    # matrix
    "feature_list": "select * from features",
    "model_features": "select * from trained",
    "feature_matrix": _packed_sql("at_risk_keys", "features", "coalesce(early_events, 0)", _KEYS),
    "sparse_matrix": """
        select user_id, snapshot_t, coalesce(string_agg(idx, ',' order by idx), '') as indices,
               coalesce(string_agg(early_events, ',' order by idx), '') as "values"
        from at_risk_keys left join usage_long using (user_id, snapshot_t) left join features using (sub_feature)
        group by user_id, snapshot_t""",
    "training_set": _packed_sql("at_risk_keys", "trained", "coalesce(early_events, 0)", f"{_KEYS}, engaged"),
    "log_features": _packed_sql(
        "at_risk_keys", "trained", "cast(round(ln(1 + coalesce(early_events, 0)) * 1000000) as bigint)", _KEYS
    ),
    "align_features": """
        select idx, t.sub_feature, l.sub_feature is not null as is_present
        from trained t left join live_features l using (sub_feature)""",
    "unseen_features": "select * from live_features anti join trained using (sub_feature)",
    "live_matrix": _packed_sql("live_keys", "trained", "coalesce(early_events, 0)", _KEYS),
    # splits
    "group_folds": "select user_id, snapshot_t, engaged, fold from at_risk_keys join dealt using (user_id)",
    "group_holdout": """
        select user_id, snapshot_t, engaged,
               cast('0x' || substr(md5(user_id || ':42'), 1, 8) as bigint) % 10000 < 2000 as is_test
        from at_risk_keys""",
    "permute_labels": """
        select t.user_id, t.snapshot_t, g.engaged from orders_of_rows t join orders_of_rows g on t.taker = g.giver""",
    # metrics
    "base_rate": """
        select count(*) as n_rows, cast(sum(engaged) as bigint) as n_pos, round(avg(engaged), 6) as base_rate
        from at_risk_keys""",
    "class_weight": """
        select n_pos, n_neg, round(n_neg / greatest(n_pos, 1), 6) as pos_weight
        from (select cast(sum(engaged) as bigint) as n_pos, cast(sum(1 - engaged) as bigint) as n_neg from at_risk_keys)""",
    "roc_auc": f"select roc_auc from ({_ranking_sql('')})",
    "average_precision": f"select average_precision from ({_ranking_sql('')})",
    "metrics_by_snapshot": f"""
        select snapshot_t, cast(n_rows as bigint) as n_rows, roc_auc, average_precision
        from ({_ranking_sql('snapshot_t')})""",
    # rankings on surrogate attributions
    "feature_direction": "select sub_feature, direction from surrogate_importance",
    "feature_importance": """
        select row_number() over (order by m desc, sub_feature) as rank, sub_feature, round_even(m, 3) as mean_abs_shap, round_even(g, 1) as gain, direction
        from surrogate_importance""",
    "importance_top10": """
        select row_number() over (order by m desc, sub_feature) as rank, sub_feature, round_even(m, 3) as mean_abs_shap, round_even(g, 1) as gain, direction
        from surrogate_importance order by m desc, sub_feature limit 10""",
    "importance_by_snapshot": "select * from surrogate_by_snapshot",
    # model-bound: what holds for any fit
    "oof_scores_holds": """
        select user_id, snapshot_t, engaged, fold, true as score from at_risk_keys join dealt using (user_id)""",
    "oof_metrics_holds": "select count(*) as n_rows, true as roc_auc, true as average_precision from at_risk_keys",
    "permutation_auc_holds": """
        select count(*) as n_rows, cast(sum(engaged) as bigint) as n_pos, true as roc_auc from at_risk_keys""",
    "fold_metrics_holds": """
        select fold, count(*) as n_rows, true as sound from marked join pool_dealt using (user_id)
        where not is_test group by fold""",
    "holdout_metrics_holds": "select count(*) as n_rows, round(avg(engaged), 6) as base_rate from marked where is_test",
    "gain_importance_holds": "select sub_feature, true as not_negative from trained",
    # months added to an older run: as if the run had known them
    "refreshed_usage": "select * from usage_long",
    "refreshed_segments": "select * from segments",
    "refreshed_personas": """
        select user_id, acct_id, score_date, tier as user_category_persona, is_test_a, is_test_b from personas""",
    "refreshed_user_facts": """
        select user_id, min(score_date) as joined, max(score_date) as last_day,
          bool_or(coalesce(is_test_a, false) or coalesce(is_test_b, false)) as ever_flagged
        from personas group by user_id""",
    "refreshed_tier_days": """
        select user_id, acct_id, score_date, tier as user_category_persona from personas
        where score_date in (select snapshot_t from grid union select check_day from grid)""",
    "new_month_scores": """
        select user_id, snapshot_t, round(1 / (1 + exp(-sum(points))), 9) as forecast_probability from (
            select k.user_id, k.snapshot_t, tree, leaf, points
            from live_keys k cross join fixed_steps s
                 left join (select user_id, snapshot_t, idx, early_events from live_usage join trained using (sub_feature)) u
                   on u.user_id = k.user_id and u.snapshot_t = k.snapshot_t and u.idx = s.f
            where s.fold = 0
            group by all having bool_and((ln(1 + coalesce(early_events, 0)) > t) = up))
        group by all""",
    # a fixed model: values, not only what holds of any
    "fixed_tree_scores": """
        select user_id, snapshot_t, engaged, fold, round(score, 9) as score
        from fixed_scores semi join dealt using (user_id, fold)""",
    "fixed_tree_in_sample": """
        select user_id, snapshot_t, engaged, fold, round(score, 9) as score
        from fixed_scores anti join dealt using (user_id, fold)""",
    "fixed_tree_metrics": "select * replace (cast(n_rows as bigint) as n_rows) from (" + _ranking_sql("", """(
        select engaged, round(score, 6) as score from fixed_scores semi join dealt using (user_id, fold))""") + ")",
    "fixed_tree_fold_metrics": "select * replace (cast(n_rows as bigint) as n_rows) from (" + _ranking_sql("fold", """(
        select engaged, fold, round(score, 6) as score from fixed_scores anti join dealt using (user_id, fold))""") + ")",
    "fixed_tree_attribution": """
        select user_id, snapshot_t, sub_feature, round(value, 9) as value, round(phi, 9) as phi
        from fixed_cells where round(phi, 9) <> 0""",
    "fixed_tree_attribution_by_leaf": """
        select user_id, snapshot_t, sub_feature, round(value, 9) as value, round(phi, 9) as phi
        from fixed_cells where round(phi, 9) <> 0""",
    "fixed_tree_gain": "select sub_feature, round(gain, 6) as gain from fixed_gain",
    "fixed_tree_importance": """
        select cast(rank as integer) as rank, sub_feature, round_even(m, 3) as mean_abs_shap, round_even(gain, 1) as gain, direction
        from fixed_ranking join fixed_gain using (sub_feature)""",
    "fixed_tree_by_snapshot": """
        select snapshot_t, n_rows, rank, sub_feature, round_even(m, 3) as mean_abs_shap from (
            select snapshot_t, sub_feature, count(*) as n_rows, avg(abs(phi)) as m,
                   cast(row_number() over (partition by snapshot_t order by round(avg(abs(phi)), 12) desc, sub_feature) as integer) as rank
            from fixed_cells group by snapshot_t, sub_feature)
        where rank <= 10""",
    "fixed_tree_per_row": """
        select user_id, snapshot_t, engaged, round(score, 9) as engaged_probability,
               string_agg(cast(cast(round(phi * 1000000) as bigint) as varchar), ',' order by rank) as cells
        from fixed_cells join fixed_ranking using (sub_feature) join fixed_scores using (user_id, snapshot_t)
             join dealt using (user_id, fold)
        where rank <= 12 group by all""",
    "oof_attribution_holds": """
        select user_id, snapshot_t, fold, true as adds_up from at_risk_keys join dealt using (user_id)""",
    "model_importance_holds": "select sub_feature, true as in_order, true as falling from trained",
    "attribution_per_row_holds": """
        select user_id, snapshot_t, engaged, cast(least((select count(*) from trained), 40) as integer) as n_features
        from at_risk_keys""",
    "live_scores_holds": "select user_id, snapshot_t, true as forecast_probability from live_keys",
    "live_importance_holds": "select sub_feature, true as not_negative from trained",
    "live_summary_holds": """
        select snapshot_t, strftime(snapshot_t, '%B %Y') as "month", cast(check_day as varchar) as check_day,
               is_training as outcome_known, (select count(*) from live_keys) as n_at_risk, true as mean_probability
        from grid where is_live""",
    "run_metrics_holds": """
        select unnest(['users_n_before', 'users_n_excluded', 'users_n_after']) as metric,
               unnest([n_before, n_before - n_after, n_after])::double as value
        from (select count(distinct user_id) as n_before from personas), (select count(*) as n_after from clean_users)
        union all
        select unnest(['panel_n_rows', 'panel_n_users', 'panel_n_pos']),
               unnest([count(*), count(distinct user_id), sum(engaged)])::double from at_risk_keys
        union all select 'panel_n_features_listed', count(*)::double from features
        union all select 'panel_n_features', count(*)::double from trained
        union all select unnest(['usage_n_rows', 'usage_n_users']), unnest([count(*), count(distinct user_id)])::double from usage_long
        union all select unnest(['snapshots_available', 'snapshots_used']), unnest([count(*), count(*)])::double
        from grid where is_training
        union all select 'segment_Paid', count(*)::double from segments where customer_segment = 'Paid'
        union all
        select unnest(['segment_n_matched', 'segment_n_total']), unnest([count(s.user_id), count(*)])::double
        from (select distinct user_id, snapshot_t from personas
              join grid on score_date = snapshot_t and (is_training or is_live) where acct_id is not null) k
        left join segments s using (user_id, snapshot_t)
        union all select 'live_n_at_risk', count(*)::double from live_keys
        union all select 'tiers_last_day', strftime(persona_max, '%Y%m%d')::double from horizon
        union all select 'tiers_is_stale', is_stale::integer::double from horizon
        union all select 'live_n_unseen_features', count(*)::double from live_features anti join trained using (sub_feature)
        union all select 'live_outcome_known', is_training::integer::double from grid where is_live""",
    "importance_latest": """
        select * from surrogate_by_snapshot where snapshot_t = (select max(snapshot_t) from surrogate_by_snapshot)""",
}


def _mentioned(sql: str) -> set[str]:
    return {name for name in BLOCKS if re.search(rf"\b(?:from|join)\s+\(?{name}\b|,\s*{name}\b", sql)}


def with_blocks(sql: str) -> str:
    """``sql`` preceded by the blocks it needs, directly or through other blocks."""
    needed, pending = set(), _mentioned(sql)
    while pending:
        name = pending.pop()
        needed.add(name)
        pending |= _mentioned(BLOCKS[name]) - needed
    ctes = [f"{name} as materialized ({body})" for name, body in BLOCKS.items() if name in needed]
    return f"with {', '.join(ctes)}\n{sql.strip()}" if ctes else sql.strip()


RAW["refreshed_metadata"] = RAW["run_metadata"]

ORACLES = {name: with_blocks(sql) for name, sql in RAW.items()}
