"""Headline timings: one JSON line with seconds per query.

Median of three runs after a warm-up; every run writes its full result to
Spark's no-op sink. ``prepare`` is the derivation of the domain tables from the
test tables, and ``train_folds`` five fresh fits with their scores; both run once.
Wide matrices are timed as their operators give them, without the text form that
their queries take for the comparison with SQL.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from tiercast.checks.queries import QUERIES, Workspace, wide_features, wide_live, workspace
from tiercast.plans.training import TrainingRun

HEADLINE = [
    "data_horizon", "exclude_flagged_users", "exclusion_counts", "user_join_date",
    "segment_at_snapshot", "segment_coverage", "panel_frame", "at_risk",
    "window_range_join", "windowed_usage", "at_risk_usage", "feature_matrix", "sparse_matrix",
    "training_set", "live_matrix", "group_folds", "permute_labels",
    "roc_auc", "average_precision", "metrics_by_snapshot",
    "feature_importance", "importance_by_snapshot",
]
#: Timed in place of the query of the name.
OPERATORS = {"feature_matrix": wide_features, "training_set": Workspace.training_set, "live_matrix": wide_live}
RUNS = 3


def seconds(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tiercast-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    timings = {"prepare": seconds(lambda: workspace(spark, sf_dir).panel)}
    w = workspace(spark, sf_dir)
    for name in HEADLINE:
        build = OPERATORS.get(name, QUERIES[name])
        drain(build(w))
        timings[name] = statistics.median(seconds(lambda: drain(build(w))) for _ in range(RUNS))

    run = TrainingRun(w.panel, w.cfg)
    timings["train_folds"] = seconds(lambda: run.oof)
    timings["oof_attribution"] = seconds(lambda: run.phi)
    timings["model_importance"] = seconds(lambda: run.ranking)
    timings["live_forecast"] = seconds(lambda: drain(w.live.scores))

    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in timings.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "panel_rows": w.panel.rows.count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
