"""Who is in the panel: test-user exclusion, join dates, segments, at-risk rows, label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tiercast.config import PanelConfig
from tiercast.functions.columns import any_of, safe_date
from tiercast.operators.calendar import on_days
from tiercast.sources.storage import spread

KEYS = ["user_id", "snapshot_t"]


def _dated(personas: DataFrame, *columns: str) -> DataFrame:
    """Tier rows with a readable day; the rest leave."""
    return personas.select(
        "user_id", safe_date(F.col("score_date")).alias("score_date"), *columns
    ).dropna(subset=["score_date"])


def _flagged(personas: DataFrame, flags: Sequence[str]) -> Column:
    return any_of([F.col(f) for f in flags])


def exclude_flagged_users(personas: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Drop every row of a user who was flagged on any day.

    The flagged set grows with the users and is not broadcast. The flags stay in the distinct key on purpose: its
    partitioning then differs from the join's, both join sides come straight
    from a shuffle, and Spark can split a user who holds much of the history.
    """
    flagged = personas.filter(_flagged(personas, flags)).select("user_id", *flags).distinct()
    return personas.join(spread(flagged.select("user_id")), "user_id", "left_anti")


def _marked(personas: DataFrame, flags: Sequence[str], *columns: str) -> DataFrame:
    return _dated(personas, *flags, *columns).select(
        "user_id", *columns, F.col("score_date").alias("joined"), F.col("score_date").alias("last_day"),
        _flagged(personas, flags).alias("ever_flagged"))


def merged_facts(facts: DataFrame, *more_keys: str) -> DataFrame:
    """One row per user (and per further keys) from any number of partial ones.

    Smallest, largest and "ever" merge in any order and any number of times, so
    facts of two halves of a history merge to those of the whole.
    """
    return facts.groupBy("user_id", *more_keys).agg(
        F.min("joined").alias("joined"), F.max("last_day").alias("last_day"), F.bool_or("ever_flagged").alias("ever_flagged"))


def user_facts(personas: DataFrame, flags: Sequence[str]) -> DataFrame:
    """First and last day and ever-flagged mark per user: one pass, combined before the shuffle."""
    return merged_facts(_marked(personas, flags))


def monthly_facts(personas: DataFrame, flags: Sequence[str]) -> DataFrame:
    """``user_facts`` per user and ``tier_month``, a column of the history."""
    return merged_facts(_marked(personas, flags, "tier_month"), "tier_month")


def join_dates(personas: DataFrame, flags: Sequence[str], facts: DataFrame | None = None) -> DataFrame:
    """First day of every user never flagged; ``facts`` spare the scan of the history."""
    facts = user_facts(personas, flags) if facts is None else facts
    return facts.filter(~F.col("ever_flagged")).select("user_id", "joined")


def exclusion_counts(personas: DataFrame, flags: Sequence[str], facts: DataFrame | None = None) -> DataFrame:
    """Users before, flagged, and after, counted over the per-user facts."""
    flagged = F.coalesce(F.sum(F.col("ever_flagged").cast("bigint")), F.lit(0))
    return (user_facts(personas, flags) if facts is None else facts).agg(
        F.count("*").alias("n_before"),
        flagged.alias("n_excluded"),
        (F.count("*") - flagged).alias("n_after"),
    )


# --- account segments -------------------------------------------------------


def _account_keys(personas: DataFrame, days: DataFrame) -> DataFrame:
    dated = _dated(personas, "acct_id").withColumnRenamed("score_date", "snapshot_t")
    return on_days(dated.dropna(subset=["acct_id"]), "snapshot_t", days)


def segment_at_snapshot(personas: DataFrame, state: DataFrame, days: DataFrame) -> DataFrame:
    """Segment per (user, snapshot): Paid if any of the user's accounts is paid that day.

    The state side is cut to the snapshot days and to distinct rows before the
    join, so a repeated state row cannot multiply users. It is made distinct by
    (account, day, paid), not aggregated by the join key: both join sides then
    come straight from a shuffle, and Spark can split an account that holds
    many of the users. The rows are regrouped by user right after.
    """
    dated = state.select(
        F.col("acct_id"),
        F.to_date("date").alias("snapshot_t"),
        F.coalesce(F.col("paid"), F.lit(False)).alias("paid"),
    )
    by_day = on_days(dated, "snapshot_t", days).distinct()
    return (
        _account_keys(personas, days)
        .join(spread(by_day), ["acct_id", "snapshot_t"])
        .groupBy(*KEYS)
        .agg(F.bool_or("paid").alias("paid"))
        .select(*KEYS, F.when(F.col("paid"), "Paid").otherwise("Other").alias("customer_segment"))
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("customer_segment").agg(F.count("*").alias("n_rows"))


def segment_coverage(personas: DataFrame, segments: DataFrame, days: DataFrame) -> DataFrame:
    """How many (user, snapshot) keys with an account found a state row."""
    # Both sides meet in one grouping: no join, and no sort of either. A key with a null meets nobody.
    keys = _account_keys(personas, days).select(*KEYS, F.lit(True).alias("asked"))
    found = segments.select(*KEYS, F.lit(False).alias("asked"))
    known = F.col("user_id").isNotNull() & F.col("snapshot_t").isNotNull()
    met = keys.unionByName(found).groupBy(*KEYS).agg(
        F.bool_or("asked").alias("asked"), F.bool_or(~F.col("asked")).alias("found"))
    return met.filter("asked").agg(F.count_if(F.col("found") & known).alias("n_matched"), F.count("*").alias("n_total"))


# --- panel frame ------------------------------------------------------------


def rows_on_grid(personas: DataFrame, grid: DataFrame) -> DataFrame:
    """The tier rows of the grid's snapshot and check days: all that panel, segments and forecast read of a history."""
    dated = _dated(personas, "acct_id", "user_category_persona")
    return on_days(dated, "score_date", _roles(grid).select("score_date"))


def _roles(grid: DataFrame) -> DataFrame:
    """The grid as days to look up: each snapshot once for its T, once for its check day."""
    check = grid.select(
        F.col("check_day").alias("score_date"), "snapshot_t", "window_start",
        F.lit(True).alias("is_check"),
    )
    return grid.select(
        F.col("snapshot_t").alias("score_date"), "snapshot_t", "window_start",
        F.lit(False).alias("is_check"),
    ).unionByName(check)


def tiers_by_role(personas: DataFrame, grid: DataFrame) -> DataFrame:
    """Tier at T and on the check day per (user, snapshot), from one scan of the history.

    Where a user has several rows on a day, the smallest (acct_id, tier) counts.
    The tier columns stay structs so that "no row" and "row without a tier" differ.
    """
    picked = F.struct("acct_id", "user_category_persona")
    roles = _roles(grid)
    dated = _dated(personas, "acct_id", "user_category_persona")
    return (
        on_days(dated, "score_date", roles.select("score_date"))
        # Two rows per calendar month: small by construction.
        .join(F.broadcast(roles), "score_date")
        .groupBy(*KEYS)
        .agg(
            F.min("window_start").alias("window_start"),  # the same for all rows of a snapshot
            F.min(F.when(~F.col("is_check"), picked)).alias("at_t"),
            F.min(F.when(F.col("is_check"), picked)).alias("at_check"),
        )
        .filter(F.col("at_t").isNotNull())
    )


def _in_tiers(col: Column, tiers: Sequence[str]) -> Column:
    return F.coalesce(col.isin(*tiers), F.lit(False))


def panel_frame(
    personas: DataFrame,
    grid: DataFrame,
    segments: DataFrame | None,
    cfg: PanelConfig,
    strict: bool = True,
    facts: DataFrame | None = None,
) -> DataFrame:
    """One row per (user, snapshot) of ``grid`` with tiers, at-risk mark and label.

    ``facts`` are the ``user_facts`` of the whole history; with them, ``personas``
    may be cut to ``rows_on_grid``.
    ``segments`` may be missing: an error when training (``strict``), no filter
    for a live cohort whose segments have not arrived yet.
    """
    if cfg.restrict_segment is not None and segments is None and strict:
        raise ValueError(
            "restrict_segment is set but there is no segment table; "
            "build it first or set restrict_segment=None"
        )
    frame = tiers_by_role(personas, grid)
    at_t, at_check = F.col("at_t.user_category_persona"), F.col("at_check.user_category_persona")
    # A plain conjunction that is never null: a filter on it splits and moves down.
    at_risk = (
        at_t.isNotNull()
        & ~at_t.isin(*cfg.exclude_tiers_at_t)
        & (F.col("joined") <= F.col("window_start"))
    )
    if cfg.joined_since is not None:
        at_risk &= F.col("joined") >= F.lit(cfg.joined_since)
    if cfg.restrict_segment is not None and segments is not None:
        # Both sides are grouped by (user, snapshot) alone: the join reuses that layout.
        in_segment = (
            segments.filter(F.col("customer_segment") == cfg.restrict_segment)
            .groupBy(*KEYS)
            .agg(F.lit(True).alias("in_segment"))
        )
        frame = frame.join(spread(in_segment), KEYS, "left")
        at_risk &= F.coalesce(F.col("in_segment"), F.lit(False))
    # One row a user on the right: hashed, so that the many rows on the left need no sort.
    return frame.join(join_dates(personas, cfg.flag_columns, facts).hint("shuffle_hash"), "user_id").select(
        *KEYS,
        "joined",
        at_t.alias("persona_at_t"),
        at_check.alias("persona_at_check"),
        F.col("at_check").isNotNull().alias("check_observed"),
        at_risk.alias("at_risk"),
        _in_tiers(at_check, cfg.power_tiers).cast("int").alias("engaged"),
    )


def at_risk_rows(frame: DataFrame) -> DataFrame:
    return frame.filter("at_risk").select(*KEYS, "engaged")


def live_population(
    personas: DataFrame, grid: DataFrame, segments: DataFrame | None, cfg: PanelConfig, facts: DataFrame | None = None
) -> DataFrame:
    """The panel rules for the live snapshot alone, without an outcome."""
    live = grid.filter("is_live")
    return panel_frame(personas, live, segments, cfg, strict=False, facts=facts).drop(
        "persona_at_check", "check_observed", "engaged"
    )
