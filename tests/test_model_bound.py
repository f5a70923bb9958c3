"""The model-bound queries give what their operators give: scores, metrics, attributions, rankings, the whole report."""

import pytest

from tiercast.checks.queries import QUERIES

VALUES = {
    "oof_scores": ["score"], "oof_metrics": ["roc_auc", "average_precision"], "permutation_auc": ["roc_auc"],
    "fold_metrics": ["train_auc", "validation_auc", "gap"], "holdout_metrics": ["roc_auc", "average_precision"],
    "gain_importance": ["gain"], "oof_attribution": ["phi"], "model_importance": ["mean_abs_shap", "gain"],
    "live_scores": ["forecast_probability"], "live_importance": ["mean_abs_shap"],
    "live_summary": ["mean_probability"], "run_metrics": ["value"],
}


@pytest.mark.parametrize("name", VALUES)
def test_values_are_returned(name, work):
    df = QUERIES[name](work)
    types = dict(df.dtypes)
    assert [types.get(c) for c in VALUES[name]] == ["double"] * len(VALUES[name])
    df.collect()


def test_scores_differ_between_rows(work):
    assert QUERIES["oof_scores"](work).select("score").distinct().count() > 1


def test_attributions_of_each_row_are_returned(work):
    df = QUERIES["attribution_per_row"](work)
    assert len(df.columns) > 4 and df.count() == work.at_risk().count()
    assert dict(df.dtypes)[df.columns[-1]] == "double"


def test_the_report_has_the_rows_of_the_fit(work):
    metrics = {r.metric for r in QUERIES["run_metrics"](work).collect()}
    assert all(any(m.startswith(p) for m in metrics) for p in ("oof_", "permuted_", "mean_", "test_"))
