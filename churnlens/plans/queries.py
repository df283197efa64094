"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Each one reads the driver tables through ``subscriber_view`` and runs one
operator of the package over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions import lenient_double
from churnlens.operators import clean, descriptive
from churnlens.plans import tables
from churnlens.session import scratch_path
from churnlens.sources.subscribers import FIXTURE_COLUMNS, csv_lines, dataset_profile, split_subscribers_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return deco


def subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.base_view(spark, sf_dir)


def feat(spark: SparkSession, sf_dir: str, totals: bool = True) -> DataFrame:
    return tables.enriched(spark, sf_dir, totals)


# ---- sources and projections ---------------------------------------------
@query("subscriber_scan")
def q_subscriber_scan(spark, sf_dir):
    return subs(spark, sf_dir).select(
        S.ID, S.TENURE, S.CONTRACT, S.INTERNET, S.MONTHLY,
        lenient_double(S.TOTAL_RAW).alias("total_charges_parsed"),
        *S.SERVICE_COLUMNS, S.CHURN,
    )


@query("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    return dataset_profile(subs(spark, sf_dir))


@query("csv_quarantine")
def q_csv_quarantine(spark, sf_dir):
    """The subscribers as CSV lines, some of them damaged by rule, read back: rows and quarantined lines by reason."""
    k, folder = F.col("k"), scratch_path(spark, "csv")
    lines = csv_lines(
        subs(spark, sf_dir).withColumn(S.TENURE, F.when(k % 101 == 7, F.lit("n/a")).otherwise(F.col(S.TENURE).cast("string"))), "k"
    )
    cut = F.when(k % 103 == 8, F.regexp_replace("value", ",[^,]*$", "")).otherwise(F.col("value"))
    lines.select(F.when(k % 107 == 9, F.concat("value", F.lit(",extra"))).otherwise(cut).alias("value")).write.text(f"{folder}/lines")
    return split_subscribers_csv(spark, f"{folder}/lines", f"{folder}/split", header=False)


@query("missing_count")
def q_missing_count(spark, sf_dir):
    return clean.missing_count(subs(spark, sf_dir))


@query("lenient_cast")
def q_lenient_cast(spark, sf_dir):
    return clean.parse_total_charges(subs(spark, sf_dir)).select(S.ID, "total_charges_parsed")


@query("impute_total_charges")
def q_impute(spark, sf_dir):
    return clean.impute_total_charges(subs(spark, sf_dir)).select(S.ID, S.TOTAL)


@query("label_map")
def q_label_map(spark, sf_dir):
    return feat(spark, sf_dir, totals=False).select(S.ID, S.CHURN, S.LABEL)


@query("tenure_group")
def q_tenure_group(spark, sf_dir):
    return feat(spark, sf_dir, totals=False).select(S.ID, S.TENURE, S.TENURE_GROUP)


@query("charges_group")
def q_charges_group(spark, sf_dir):
    return feat(spark, sf_dir, totals=False).select(S.ID, S.MONTHLY, S.CHARGES_GROUP)


@query("total_charges_group")
def q_total_group(spark, sf_dir):
    return feat(spark, sf_dir).select(S.ID, S.TOTAL, S.TOTAL_GROUP)


@query("risk_segment")
def q_risk_segment(spark, sf_dir):
    return feat(spark, sf_dir, totals=False).select(S.ID, S.CONTRACT, S.TENURE, S.RISK_SEGMENT)


@query("service_count")
def q_service_count(spark, sf_dir):
    return feat(spark, sf_dir, totals=False).select(S.ID, S.SERVICE_COUNT)


@query("high_value_flag")
def q_high_value(spark, sf_dir):
    return feat(spark, sf_dir, totals=False).select(S.ID, S.MONTHLY, S.CONTRACT, S.HIGH_VALUE)


# ---- descriptive ----------------------------------------------------------
def _descriptive(name: str, op):
    @query(name)
    def q(spark, sf_dir):
        return op(feat(spark, sf_dir, totals=False))

    q.__name__ = f"q_{name}"
    return q


for _name in [
    "churn_distribution",
    "churn_revenue",
    "charges_churn_count",
    "tenure_churn_count",
    "contract_churn_count",
    "charges_churn_rate",
    "tenure_churn_rate",
    "contract_churn_rate",
    "internet_churn_crosstab",
    "service_churn_rate",
    "service_rate_wide",
    "service_count_wide",
]:
    _descriptive(_name, getattr(descriptive, _name))


# ---- scorecard: fixture score standing in for a model probability ---------
from churnlens.operators import metrics, retention, segments, split  # noqa: E402
from churnlens.operators.features import scorecard  # noqa: E402
from churnlens.operators.model import feature_columns  # noqa: E402


def sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard(feat(spark, sf_dir), "score")


@query("churn_risk_band")
def q_churn_risk_band(spark, sf_dir):
    return sc(spark, sf_dir).select(S.ID, S.PROB, S.RISK_BAND)


@query("segment_profile")
def q_segment_profile(spark, sf_dir):
    return segments.segment_profile(sc(spark, sf_dir))


for _key, (_dim, _col) in zip(
    ["segment_tenure", "segment_contract", "segment_charges", "segment_internet", "segment_risk"],
    S.PROFILE_DIMENSIONS,
):
    def _mk(dim):
        return lambda spark, sf_dir: segments.profile_by(sc(spark, sf_dir), dim)

    query(_key)(_mk(_dim))


@query("revenue_at_risk")
def q_revenue_at_risk(spark, sf_dir):
    return retention.revenue_at_risk(sc(spark, sf_dir))


@query("high_risk_filter")
def q_high_risk_filter(spark, sf_dir):
    return retention.high_risk(sc(spark, sf_dir)).select(S.ID, S.PROB, "monthly_revenue_at_risk")


@query("segment_membership")
def q_segment_membership(spark, sf_dir):
    return retention.segment_membership(sc(spark, sf_dir))


@query("retention_segments")
def q_retention_segments(spark, sf_dir):
    return retention.retention_segments(sc(spark, sf_dir))


@query("retention_plan")
def q_retention_plan(spark, sf_dir):
    return retention.retention_plan(sc(spark, sf_dir))


@query("report_lines")
def q_report_lines(spark, sf_dir):
    return retention.report_lines(sc(spark, sf_dir))


@query("high_risk_extract")
def q_high_risk_extract(spark, sf_dir):
    df = sc(spark, sf_dir)
    return retention.high_risk_extract(df, feature_columns(df, FIXTURE_COLUMNS))


def sc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(sc(spark, sf_dir))


def sc_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc_split(spark, sf_dir).where(F.col("split") == "test")


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return sc_split(spark, sf_dir).select(S.ID, S.LABEL, "split")


@query("split_balance")
def q_split_balance(spark, sf_dir):
    return split.split_balance(sc_split(spark, sf_dir))


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(sc_test(spark, sf_dir))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(sc_test(spark, sf_dir))


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    return metrics.roc_curve(sc_test(spark, sf_dir))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return metrics.roc_auc(sc_test(spark, sf_dir))


@query("evaluation_table")
def q_evaluation_table(spark, sf_dir):
    return metrics.evaluation_table(sc_test(spark, sf_dir))


# ---- model: encoding, training, scoring, explanation -----------------------
from churnlens.operators import explain as X  # noqa: E402
from churnlens.operators import model as M  # noqa: E402
from churnlens.operators import stages  # noqa: E402
from churnlens.plans import modelling as MP  # noqa: E402


@query("model_features")
def q_model_features(spark, sf_dir):
    return MP.model_feature_frame(feat(spark, sf_dir))


@query("label_encode")
def q_label_encode(spark, sf_dir):
    return M.label_encode(feat(spark, sf_dir), exclude=FIXTURE_COLUMNS)


@query("train_model")
def q_train_model(spark, sf_dir):
    """Trains anew on the given tables, whatever is stored."""
    return MP.tree_summary(MP.fitted(spark, sf_dir, refresh=True), spark)


@query("predict_test")
def q_predict_test(spark, sf_dir):
    return MP.scored_test(spark, sf_dir).select(S.ID, S.LABEL, S.PROB, S.PRED)


@query("batch_score")
def q_batch_score(spark, sf_dir):
    return MP.scored_all(spark, sf_dir).select(S.ID, "split", S.PROB, S.PRED, S.RISK_BAND)


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return MP.importances(spark, sf_dir)


@query("top_features")
def q_top_features(spark, sf_dir):
    return MP.importances(spark, sf_dir).limit(S.TOP_FEATURES)


@query("learning_curve")
def q_learning_curve(spark, sf_dir):
    """AUC on the training and the test rows after every boosting round."""
    rows = MP.split_table(spark, sf_dir).where(F.col("split").isNotNull())
    return stages.learning_curve(rows, MP.fitted(spark, sf_dir))


@query("model_evaluation")
def q_model_evaluation(spark, sf_dir):
    return metrics.evaluation_table(MP.scored_test(spark, sf_dir))


@query("model_classification_metrics")
def q_model_metrics(spark, sf_dir):
    return metrics.classification_metrics(MP.scored_test(spark, sf_dir))


@query("model_roc_auc")
def q_model_auc(spark, sf_dir):
    return metrics.roc_auc(MP.scored_test(spark, sf_dir))


@query("model_confusion_matrix")
def q_model_confusion(spark, sf_dir):
    return metrics.confusion_matrix(MP.scored_test(spark, sf_dir))


@query("model_roc_curve")
def q_model_roc(spark, sf_dir):
    return metrics.roc_curve(MP.scored_test(spark, sf_dir))


@query("model_segment_profile")
def q_model_segment_profile(spark, sf_dir):
    return segments.segment_profile(MP.scored_all(spark, sf_dir))


@query("model_revenue_at_risk")
def q_model_revenue(spark, sf_dir):
    return retention.revenue_at_risk(MP.scored_all(spark, sf_dir))


@query("model_retention_plan")
def q_model_plan(spark, sf_dir):
    return retention.retention_plan(MP.scored_all(spark, sf_dir))


@query("model_high_risk_extract")
def q_model_extract(spark, sf_dir):
    df = MP.scored_all(spark, sf_dir)
    return retention.high_risk_extract(df, MP.fitted(spark, sf_dir).features)


@query("shap_importance")
def q_shap_importance(spark, sf_dir):
    return X.shap_importance(MP.scored_test(spark, sf_dir), MP.fitted(spark, sf_dir))


@query("export_results")
def q_export_results(spark, sf_dir):
    from churnlens.sources.sinks import export_results

    model = MP.fitted(spark, sf_dir)
    scored = MP.scored_all(spark, sf_dir)
    tables = {
        "model_evaluation": metrics.evaluation_table(MP.scored_test(spark, sf_dir)),
        "feature_importance": MP.importances(spark, sf_dir),
        "segment_profile": segments.segment_profile(scored),
        "retention_plan": retention.retention_plan(scored),
        "high_risk_customers": retention.high_risk_customers(scored, model.features),
    }
    return export_results(tables, MP.store_path(spark, sf_dir) + "/export").drop("path")


@query("scored_rows")
def q_scored_rows(spark, sf_dir):
    """Every subscriber is scored: rows per split and label, and those without a probability."""
    return MP.scored_all(spark, sf_dir).groupBy("split", S.LABEL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(S.PROB).isNull()).alias("n_unscored")
    )


@query("report_tables")
def q_report_tables(spark, sf_dir):
    """Evaluation and segment sections of the report as lines (scorecard)."""
    return retention.table_lines(metrics.evaluation_table(sc_test(spark, sf_dir)), segments.segment_profile(sc(spark, sf_dir)))


@query("model_report_lines")
def q_model_report_lines(spark, sf_dir):
    """The whole report as lines, from the model's scores."""
    scored = MP.scored_all(spark, sf_dir)
    first = retention.table_lines(
        metrics.evaluation_table(MP.scored_test(spark, sf_dir)), segments.segment_profile(scored), MP.importances(spark, sf_dir)
    )
    return first.unionByName(retention.report_lines(scored))


@query("plan_action_text")
def q_plan_action_text(spark, sf_dir):
    """Action items of the plan rows present in the data, joined with '; '."""
    return retention.retention_plan(sc(spark, sf_dir)).select("segment_id", "segment", "action_items")


@query("service_display_name")
def q_service_display_name(spark, sf_dir):
    """Short chart label and file key of every service seen with a Yes/No level."""
    return descriptive.service_churn_rate(feat(spark, sf_dir, totals=False)).select(
        "service", "display_name", "file_key"
    ).distinct()
