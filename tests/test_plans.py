"""Physical-plan shape checks: pushdown, pruning, single scans, top-k, broadcasts."""

import re

import pytest

import __spark_entry__ as E
from churnlens import schema as S

from conftest import SF_CHECK


@pytest.fixture(autouse=True)
def _no_cached_tables(spark):
    # other test modules cache shared tables; plans here must show the scans
    spark.catalog.clearCache()


@pytest.fixture
def written(spark):
    """The shared subscriber table is there (reports that need totals write it)."""
    from churnlens.plans import tables

    return tables.enriched(spark, SF_CHECK)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _scans(text: str) -> int:
    """Number of parquet scan nodes (detail headers of the formatted plan)."""
    return len(re.findall(r"^\(\d+\) Scan parquet", text, flags=re.M))


def test_orders_filter_pushed_and_columns_pruned(spark):
    from churnlens.sources.subscribers import subscriber_view

    df = subscriber_view(spark, SF_CHECK).groupBy("tenure").count()
    text = _formatted(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in text
    assert "o_totalprice" not in text


def test_service_rates_scan_each_table_once(spark, written):
    text = _formatted(E.queries()["service_churn_rate"](spark, SF_CHECK))
    assert _scans(text) == 1  # the subscriber table once (six services via Expand)
    assert "Expand" in text
    schema = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")][0]
    cols = set(re.findall(r"(\w+):string", schema))
    assert cols == {"churn", *S.SERVICE_COLUMNS}  # pruned to the 7 needed columns


def test_reports_read_the_written_subscriber_table(spark, written):
    text = _formatted(E.queries()["tenure_churn_rate"](spark, SF_CHECK))
    assert _scans(text) == 1 and "churnlens-tables" in text
    assert "o_orderdate" not in text  # no orders aggregate per report


def test_reports_without_totals_write_nothing(spark, monkeypatch):
    from churnlens.plans import tables

    tables.drop_tables(spark, SF_CHECK)
    monkeypatch.setattr("churnlens.operators.clean.exact_median", lambda *a, **k: pytest.fail("median not needed"))
    text = _formatted(E.queries()["label_map"](spark, SF_CHECK))
    assert "churnlens-tables" not in text


def test_segment_profile_single_pass(spark):
    text = _formatted(E.queries()["segment_profile"](spark, SF_CHECK))
    assert _scans(text) == 1  # one scan for the five dimensions


def test_high_risk_extract_is_top_k(spark):
    assert "TakeOrderedAndProject" in _plan(E.queries()["high_risk_extract"](spark, SF_CHECK))


def test_split_labels_rows_in_a_narrow_map(spark):
    plan = _plan(E.queries()["stratified_split"](spark, SF_CHECK))
    assert "Window" not in plan and "Join" not in plan  # the only exchange is for exact copies at the cut


def test_retention_plan_dimension_broadcast(spark):
    text = _formatted(E.queries()["retention_plan"](spark, SF_CHECK))
    assert "BroadcastExchange" in text
    assert _scans(text) == 1
