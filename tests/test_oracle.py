"""Every SQL-checkable query equals its DuckDB statement (the driver's check)."""

import pytest

import __spark_entry__ as E
from churnlens.plans.oracle import SQL
from churnlens.plans.queries import QUERIES
from oracle_compare import compare, duck

from conftest import SF_CHECK, SF_SMALL

# scored_rows trains the full model; test_registered_model_queries.py checks it with few rounds
KEYS = sorted(set(SQL) - {"scored_rows"})


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(spark, name, SF_CHECK, con)
    assert ok, msg


def test_every_query_has_oracle_or_is_model_based():
    model_based = {k for k in QUERIES if k not in SQL}
    assert model_based <= {
        "train_model", "predict_test", "batch_score", "feature_importance", "top_features", "model_evaluation",
        "model_confusion_matrix", "model_roc_curve", "model_classification_metrics", "model_roc_auc", "model_segment_profile", "model_revenue_at_risk",
        "model_retention_plan", "model_high_risk_extract", "shap_importance", "export_results", "model_report_lines", "learning_curve",
    }


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["dimension", "level", "actual_churn_rate", "avg_churn_probability",
                          "avg_monthly_charges", "customer_count"]
