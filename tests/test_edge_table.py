"""The 12-row edge table of FIXTURES.md section 3 with its expected values."""

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import descriptive, metrics
from churnlens.operators.features import enrich, scorecard
from churnlens.operators.segments import profile_by

SVC = {"y": "Yes", "n": "No", "i": "No internet service", "-": None, "?": "maybe"}
ROWS = [
    ("E01", 0, "Month-to-month", 20.00, " ", "nnnnnn", "Yes", 0.0),
    ("E02", 12, "Month-to-month", 30.00, "1000", "yyyyyy", "Yes", 0.3),
    ("E03", 11, "Month-to-month", 30.25, "1000.5", "iiiiii", "No", 0.3125),
    ("E04", 13, "One year", 50.00, "2000", "ynnnnn", "No", 0.6),
    ("E05", 24, "Two year", 70.00, "3000", "yynnnn", "Yes", 0.625),
    ("E06", 25, "Two year", 70.25, "4000", "nnnnyn", "No", 1.0),
    ("E07", 60, "Two year", 90.00, "4000.25", "nnnnny", "No", 0.5),
    ("E08", 61, "One year", 90.25, "10000", "nnnnyy", "Yes", 0.75),
    ("E09", 100, "Month-to-month", 200.00, "10000.5", "n-nnnn", "No", 0.75),
    ("E10", 101, "Month-to-month", 200.25, "abc", "yyynnn", "Yes", 0.9),
    ("E11", None, "Month-to-month", 0.00, None, "------", None, 0.8),
    ("E12", 72, None, 80.00, "0", "?nnnnn", "No", 0.7),
]
EXPECTED = {
    "E01": (None, "0-30", 3000.0, "2K-3K", "High", 0, 0, None),
    "E02": ("0-12", "0-30", 1000.0, "0-1K", "Medium", 6, 0, "Low"),
    "E03": ("0-12", "30-50", 1000.5, "1K-2K", "High", 0, 0, "Medium"),
    "E04": ("13-24", "30-50", 2000.0, "1K-2K", "Low", 1, 0, "Medium"),
    "E05": ("13-24", "50-70", 3000.0, "2K-3K", "Low", 2, 0, "High"),
    "E06": ("25-36", "70-90", 4000.0, "3K-4K", "Low", 1, 1, "High"),
    "E07": ("49-60", "70-90", 4000.25, "4K+", "Low", 1, 1, "Medium"),
    "E08": ("61+", "90+", 10000.0, "4K+", "Low", 2, 0, "High"),
    "E09": ("61+", "90+", 10000.5, None, "Medium", 1, 0, "High"),
    "E10": (None, None, 3000.0, "2K-3K", "Medium", 3, 0, "High"),
    "E11": (None, None, 3000.0, "2K-3K", "Low", 6, 0, "High"),
    "E12": ("61+", "70-90", 3000.0, "2K-3K", "Low", 1, 0, "High"),
}


@pytest.fixture(scope="module")
def edge(spark):
    data = []
    for rid, ten, con, mon, raw, svc, churn, score in ROWS:
        internet = "No" if svc == "iiiiii" else "DSL"
        data.append((rid, ten, con, internet, mon, raw, *[SVC[c] for c in svc], churn, score))
    schema = (
        "customer_id string, tenure int, contract string, internet_service string, monthly_charges double, "
        "total_charges_raw string, " + ", ".join(f"{c} string" for c in S.SERVICE_COLUMNS)
        + ", churn string, score double"
    )
    return scorecard(enrich(spark.createDataFrame(data, schema)), "score").cache()


def test_derived_columns(edge):
    cols = [S.TENURE_GROUP, S.CHARGES_GROUP, S.TOTAL, S.TOTAL_GROUP, S.RISK_SEGMENT, S.SERVICE_COUNT,
            S.HIGH_VALUE, S.RISK_BAND]
    got = {r[S.ID]: tuple(r[c] for c in cols) for r in edge.select(S.ID, *cols).collect()}
    assert got == EXPECTED


def test_tenure_rates(edge):
    got = {r[S.TENURE_GROUP]: (r["customers"], r["churn_rate_pct"]) for r in descriptive.tenure_churn_rate(edge).collect()}
    assert got["0-12"] == (2, 50.0)
    assert got["13-24"] == (2, 50.0)
    assert got["25-36"] == (1, 0.0)
    assert got["37-48"] == (0, None)
    assert got["49-60"] == (1, 0.0)
    assert got["61+"][0] == 3 and got["61+"][1] == pytest.approx(100 / 3)


def test_risk_segment_rate_counts_missing_churn(edge):
    low = [r for r in profile_by(edge, "RiskSegment").collect() if r["level"] == "Low"][0]
    assert low["customer_count"] == 7
    assert low["actual_churn_rate"] == round(2 / 7, 4)


def test_metrics_on_edge(edge):
    m = metrics.classification_metrics(edge).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (3, 4, 2, 2)
    assert m["accuracy"] == pytest.approx(5 / 11)
    assert m["precision"] == pytest.approx(3 / 7)
    assert m["recall"] == pytest.approx(3 / 5)
    assert metrics.roc_auc(edge).first()["auc"] == pytest.approx(12.5 / 30)


def test_missing_count(edge):
    from churnlens.operators.clean import missing_count

    r = missing_count(edge).first()
    assert r["missing_total_charges"] == 3 and r["n_rows"] == 12


def test_retention_membership_rules(edge):
    from churnlens.operators.retention import segment_membership

    got = sorted((r[S.ID], r["segment_id"]) for r in segment_membership(edge).collect())
    # High band: E05 E06 E08 E09 E10 E11 E12
    assert ("E10", 1) not in got  # tenure 101 is not < 12
    assert ("E09", 2) in got and ("E10", 2) in got  # month-to-month, > 70
    assert ("E06", 4) in got and ("E12", 4) in got  # fewer than 2 services
    assert ("E05", 4) not in got  # exactly 2 services
    assert ("E06", 5) in got and ("E08", 5) in got  # streaming users
    assert ("E11", 5) not in got  # missing streaming values are not 'Yes'
