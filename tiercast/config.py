"""Every knob of a panel run, in one immutable object."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelParams:
    """Boosted-tree settings, passed on to Spark ML's ``GBTClassifier``."""

    # The published training setup.
    trees: int = 150
    depth: int = 3
    learning_rate: float = 0.05
    row_share: float = 0.7
    feature_share: float = 0.5
    min_rows_per_leaf: int = 15


@dataclass(frozen=True)
class PanelConfig:
    # Calendar: features cover [T - (window_days - 1), T], the outcome is read
    # on the single day T + buffer_days + 1.
    window_days: int = 30
    buffer_days: int = 29
    training_months: int | None = 4

    # Population and label.
    power_tiers: tuple[str, ...] = ("Power User", "Elite Power User")
    exclude_tiers_at_t: tuple[str, ...] = ("Inactive", "Power User", "Elite Power User")
    flag_columns: tuple[str, ...] = ("is_test_a", "is_test_b")
    restrict_segment: str | None = "Paid"
    joined_since: dt.date | None = None

    # Usage scope.
    products: tuple[str, ...] = ()
    denied_features: tuple[str, ...] = ()
    denied_prefix: str | None = None
    dedupe_catalog: bool = False

    # Feature list.
    exclude_features: tuple[str, ...] = ()

    # Evaluation and reporting.
    n_folds: int = 5
    test_share: float = 0.2
    seed: int = 42
    top_n: int = 10
    wide_top: int = 40
    parallel_fits: int = 5
    # Training rows of one task. Every tree level runs a job over all tasks, so small ones are
    # all overhead. Part of the model's definition: row sampling goes by task.
    fit_rows_per_task: int = 5_000
    model: ModelParams = field(default_factory=ModelParams)

    def __post_init__(self) -> None:
        if self.window_days < 1:
            raise ValueError("window_days must be at least 1")
        if self.buffer_days < self.window_days - 1:
            # The tier read on the check day looks back window_days days; a
            # shorter buffer would let that look-back reach the feature window.
            raise ValueError(
                f"buffer_days={self.buffer_days} leaks: the outcome's look-back of "
                f"{self.window_days} days would overlap the feature window; "
                f"use at least {self.window_days - 1}"
            )
        if self.n_folds < 2:
            raise ValueError("n_folds must be at least 2")
