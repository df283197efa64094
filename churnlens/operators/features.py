"""Feature derivation: bins, risk segment, service count, value flag, label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import functions as fn
from churnlens import schema as S
from churnlens.operators.clean import impute_total_charges


def enrich(df: DataFrame, with_totals: bool = True, median: float | None = None) -> DataFrame:
    """All derived subscriber columns in one projection.

    ``with_totals`` adds the imputed total and its group (it needs the
    median, i.e. a few small jobs); descriptive queries that never read the
    total skip it.
    """
    if with_totals:
        df = impute_total_charges(df, median=median)
    cols = [
        fn.label_map(S.CHURN).alias(S.LABEL),
        fn.tenure_group(S.TENURE).alias(S.TENURE_GROUP),
        fn.charges_group(S.MONTHLY).alias(S.CHARGES_GROUP),
        fn.risk_segment(S.CONTRACT, S.TENURE).alias(S.RISK_SEGMENT),
        fn.service_count(S.SERVICE_COLUMNS).alias(S.SERVICE_COUNT),
        fn.high_value(S.MONTHLY, S.CONTRACT).alias(S.HIGH_VALUE),
    ]
    if with_totals:
        cols.append(fn.total_charges_group(S.TOTAL).alias(S.TOTAL_GROUP))
    return df.select("*", *cols)


def scorecard(df: DataFrame, prob_col: str = "score") -> DataFrame:
    """Enriched rows with a probability column and its risk band.

    ``prob_col`` is the model probability after ``batch_score`` or, for
    checks against SQL, the deterministic fixture score.
    """
    out = df if prob_col == S.PROB else df.withColumn(S.PROB, F.col(prob_col).cast("double"))
    return out.withColumn(S.RISK_BAND, fn.churn_risk_band(S.PROB))
