from churnlens.operators import model as M
from churnlens.plans import workflow
from churnlens.sources import subscriber_view

from conftest import SF_SMALL


def test_descriptive_run(spark):
    out = workflow.descriptive_tables(subscriber_view(spark, SF_SMALL))
    assert set(out) == set(workflow.DESCRIPTIVE)
    assert out["churn_distribution"].count() == 2
    assert out["tenure_churn_rate"].count() == 6


def test_model_run(spark):
    out = workflow.model_tables(subscriber_view(spark, SF_SMALL), M.GBTParams(rounds=3, depth=3))
    assert out["model_evaluation"].count() == 5
    assert out["confusion_matrix"].count() == 4
    assert out["segment_profile"].count() > 0
    assert out["report_lines"].count() >= 3
    assert out["shap_importance"].count() == len(out["feature_importance"].collect())


def test_csv_user_path(spark, tmp_path):
    """CSV in the public telco layout -> both runs -> one dataset per table."""
    from pyspark.sql import functions as F

    from churnlens import schema as S
    from churnlens.sources import export_results, read_subscribers_csv

    v = subscriber_view(spark, SF_SMALL)
    filler = {"gender": F.lit("Female"), "senior_citizen": F.lit(0), "partner": F.lit("No"),
              "dependents": F.lit("No"), "phone_service": F.lit("Yes"), "multiple_lines": F.lit("No"),
              "paperless_billing": F.lit("Yes"), "payment_method": F.lit("Mailed check")}
    csv = v.select(*[(filler[dst] if dst in filler else F.col(dst)).alias(src) for src, dst, _ in S.CSV_COLUMNS])
    path = str(tmp_path / "subs_csv")
    csv.write.option("header", True).csv(path)
    subs = read_subscribers_csv(spark, path)
    assert subs.count() == v.count()
    tables = {**workflow.descriptive_tables(subs), **workflow.model_tables(subs, M.GBTParams(rounds=2, depth=2))}
    out = export_results(tables, str(tmp_path / "export"))
    assert out.count() == len(tables)
    assert out.where("rows = 0").count() == 0
