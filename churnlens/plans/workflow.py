"""The two runs of the original workflow on any subscriber table.

``descriptive_tables`` is the descriptive run (counts, shares, rates,
crosstab, service rates); ``model_tables`` is the model run (split, train,
evaluate, explain, score everything, profile segments, plan retention).
Both take a subscriber DataFrame with the internal column names, e.g. from
``read_subscribers_csv`` or ``subscriber_view``, and return named
DataFrames; ``sources.export_results`` writes them one dataset each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators import descriptive, metrics, retention, segments, split, stages
from churnlens.operators import explain as X
from churnlens.operators import model as M
from churnlens.operators.features import enrich
from churnlens.session import scratch_path

DESCRIPTIVE = [
    "churn_distribution",
    "churn_revenue",
    "charges_churn_count",
    "charges_churn_rate",
    "tenure_churn_count",
    "tenure_churn_rate",
    "contract_churn_count",
    "contract_churn_rate",
    "internet_churn_crosstab",
    "service_rate_wide",
    "service_count_wide",
    "service_churn_rate",
]


def descriptive_tables(subscribers: DataFrame) -> dict[str, DataFrame]:
    """Every table behind the descriptive charts, from one enriched input."""
    df = enrich(subscribers)
    return {name: getattr(descriptive, name)(df) for name in DESCRIPTIVE}


def model_tables(subscribers: DataFrame, params: M.GBTParams = M.GBTParams(), exclude=()) -> dict[str, DataFrame]:
    """Train on the stratified split, then score the whole table once.

    ``exclude`` names columns that are no model inputs.  The enriched and the
    scored table are written under the shared checkpoint folder and every
    report reads them (lineage cut, nothing re-scored per report); the folder
    is asked for before anything is trained.
    """
    spark = subscribers.sparkSession
    folder = scratch_path(spark, "workflow")
    path = f"{folder}/scored"
    enrich(subscribers).write.parquet(f"{folder}/subscribers")
    df = spark.read.parquet(f"{folder}/subscribers")
    sp = split.stratified_split(df)
    model = M.train(df, sp.where(F.col("split") == "train"), params, exclude)
    M.score(model, sp).write.partitionBy("split").parquet(path)
    scored = spark.read.parquet(path)
    test = scored.where(F.col("split") == "test")
    return {
        "model_evaluation": metrics.evaluation_table(test),
        "confusion_matrix": metrics.confusion_matrix(test),
        "roc_curve": metrics.roc_curve(test),
        "feature_importance": stages.gain_importance(sp.where(F.col("split") == "train"), model),
        "learning_curve": stages.learning_curve(sp.where(F.col("split").isNotNull()), model),
        "shap_importance": X.shap_importance(test, model),
        "segment_profile": segments.segment_profile(scored),
        "revenue_at_risk": retention.revenue_at_risk(scored),
        "retention_plan": retention.retention_plan(scored),
        "high_risk_customers": retention.high_risk_customers(scored, model.features),
        "report_lines": retention.report_lines(scored),
    }
