"""Every registered model query, run on the smallest input with few rounds."""

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import model as M
from churnlens.plans import modelling as MP
from churnlens.plans.queries import QUERIES

from conftest import SF_CHECK, SF_SMALL

FEW = M.GBTParams(rounds=8, depth=3)


@pytest.fixture(scope="module", autouse=True)
def few_rounds():
    patch = pytest.MonkeyPatch()
    for f in (MP.fitted, MP.scored_all, MP.scored_test, MP.store_path):
        patch.setattr(f, "__defaults__", tuple(FEW if isinstance(d, M.GBTParams) else d for d in f.__defaults__))
    yield
    patch.undo()


def _rows(spark, name, sf=SF_SMALL):
    return QUERIES[name](spark, sf).collect()


def test_training_scoring_and_importances(spark):
    trees = _rows(spark, "train_model")
    assert len(trees) == FEW.rounds and all(t["depth"] <= FEW.depth for t in trees)
    n = MP.subscribers(spark, SF_SMALL).count()
    scored = _rows(spark, "batch_score")
    assert len(scored) == n and all(0 <= r[S.PROB] <= 1 for r in scored)
    test = _rows(spark, "predict_test")
    assert len(test) == sum(r["split"] == "test" for r in scored)
    assert sum(r["n_rows"] for r in _rows(spark, "scored_rows")) == n
    importance = _rows(spark, "feature_importance")
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)
    values = [r["importance"] for r in importance]
    assert values == sorted(values, reverse=True)
    assert [r["feature"] for r in _rows(spark, "top_features")] == [r["feature"] for r in importance][: S.TOP_FEATURES]
    shap = _rows(spark, "shap_importance")
    assert {r["feature"] for r in shap} == {r["feature"] for r in importance} and all(r["mean_abs_shap"] >= 0 for r in shap)


def test_metrics_agree_with_each_other(spark):
    n = len(_rows(spark, "predict_test"))
    m = _rows(spark, "model_classification_metrics")[0]
    assert m["n"] == n == m["tp"] + m["fp"] + m["fn"] + m["tn"]
    cells = {(r["actual"], r["predicted"]): r["count"] for r in _rows(spark, "model_confusion_matrix")}
    assert cells == {(1, 1): m["tp"], (0, 1): m["fp"], (1, 0): m["fn"], (0, 0): m["tn"]}
    table = {r["metric"]: r["value"] for r in _rows(spark, "model_evaluation")}
    auc = _rows(spark, "model_roc_auc")[0]["auc"]
    assert table["Accuracy"] == pytest.approx(m["accuracy"]) and table[S.METRIC_NAMES[-1]] == pytest.approx(auc)
    curve = sorted((r["fpr"], r["tpr"]) for r in _rows(spark, "model_roc_curve"))
    assert curve[0] == (0, 0) and curve[-1] == (1, 1)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(auc)


def test_reports_and_export(spark):
    scored = QUERIES["batch_score"](spark, SF_SMALL)
    high = scored.where(F.col(S.RISK_BAND) == S.HIGH_RISK_BAND).count()
    profile = _rows(spark, "model_segment_profile")
    assert {r["dimension"] for r in profile} == {d for d, _ in S.PROFILE_DIMENSIONS}
    assert _rows(spark, "model_revenue_at_risk")[0]["high_risk_customers"] == high
    assert len(_rows(spark, "model_retention_plan")) <= 5
    extract = _rows(spark, "model_high_risk_extract")
    assert len(extract) == min(high, S.HIGH_RISK_EXTRACT_ROWS)
    lines = _rows(spark, "model_report_lines")
    assert {r["section"] for r in lines} >= {"evaluation", "features", "segments", "summary"}
    assert len({(r["section"], r["line_no"]) for r in lines}) == len(lines)
    first, again = _rows(spark, "export_results"), _rows(spark, "export_results")
    assert sorted(first) == sorted(again)
    assert {r["dataset"]: r["rows"] for r in first}["high_risk_customers"] == high


def test_model_is_better_than_chance(spark):
    assert _rows(spark, "model_roc_auc", SF_CHECK)[0]["auc"] > 0.55
