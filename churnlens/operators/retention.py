"""High-risk targeting: revenue at risk, retention segments and plan, ranked extract.

The five retention segments overlap (a customer may be in several).  Each
high-risk row gets the array of segment ids whose rule it meets; one
``explode`` + group-by then computes all five segments in a single pass
(rather than five filtered scans).  The plan text is a fixed five-row
dimension joined (broadcast, constant size) after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import functions as fn
from churnlens import schema as S

BASIC_COLUMNS = [S.ID, S.PROB, S.RISK_BAND, S.CONTRACT, S.TENURE, S.MONTHLY, S.INTERNET, "monthly_revenue_at_risk"]


def segment_rules() -> list[tuple[int, Column]]:
    """(segment id, predicate) in plan order; null comparisons count as false."""
    mtm = F.col(S.CONTRACT) == S.MONTH_TO_MONTH
    return [
        (1, mtm & (F.col(S.TENURE) < S.RISK_TENURE_CUTOFF)),
        (2, (F.col(S.MONTHLY) > S.HIGH_VALUE_CHARGE) & mtm),
        (3, F.col(S.INTERNET) == S.FIBER),
        (4, F.col(S.SERVICE_COUNT) < S.LOW_SERVICE_COUNT),
        (5, (F.col("streaming_tv") == S.YES) | (F.col("streaming_movies") == S.YES)),
    ]


def high_risk(scored: DataFrame) -> DataFrame:
    """Rows in the High risk band with their monthly revenue at risk (pushed-down filter)."""
    return scored.where(F.col(S.RISK_BAND) == S.HIGH_RISK_BAND).withColumn(
        "monthly_revenue_at_risk", F.col(S.MONTHLY)
    )


def revenue_at_risk(scored: DataFrame) -> DataFrame:
    """High-risk customer count, monthly and annual revenue at risk (one aggregate)."""
    return high_risk(scored).agg(
        F.count(F.lit(1)).alias("high_risk_customers"),
        F.coalesce(F.sum(S.MONTHLY), F.lit(0.0)).alias("monthly_revenue_at_risk"),
    ).withColumn("annual_revenue_at_risk", F.col("monthly_revenue_at_risk") * 12)


def segment_membership(scored: DataFrame) -> DataFrame:
    """(customer_id, segment_id) for every high-risk customer and segment it falls in."""
    ids = F.array_compact(F.array(*[F.when(rule, F.lit(i)) for i, rule in segment_rules()]))
    return high_risk(scored).select(S.ID, S.PROB, S.MONTHLY, F.explode(ids).alias("segment_id"))


def retention_segments(scored: DataFrame) -> DataFrame:
    """Count, mean probability and monthly revenue at risk per non-empty segment."""
    return segment_membership(scored).groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg(S.PROB).alias("avg_churn_probability"),
        F.sum(S.MONTHLY).alias("monthly_revenue_at_risk"),
    )


def plan_dimension(spark) -> DataFrame:
    """The fixed plan text, action items joined with '; '."""
    cols = ["segment_id", "segment", "strategy", "action_list", "expected_impact", "cost_per_customer", "roi"]
    df = fn.literal_table(spark, cols, S.RETENTION_PLAN)
    return df.withColumn("action_items", F.concat_ws(S.ACTION_SEPARATOR, "action_list")).drop("action_list")


def retention_plan(scored: DataFrame) -> DataFrame:
    """Plan rows for the non-empty segments: metrics plus strategy text."""
    seg = retention_segments(scored)
    plan = F.broadcast(plan_dimension(scored.sparkSession))
    return seg.join(plan, "segment_id").select(
        "segment_id",
        "segment",
        F.col("customer_count").cast("bigint").alias("customer_count"),
        F.col("avg_churn_probability").cast("double").alias("avg_churn_probability"),
        F.col("monthly_revenue_at_risk").cast("double").alias("monthly_revenue_at_risk"),
        "strategy",
        "action_items",
        "expected_impact",
        "cost_per_customer",
        "roi",
    )


def high_risk_customers(scored: DataFrame, feature_columns: list[str]) -> DataFrame:
    """All high-risk customers: basic columns, then the model's input features (each name once)."""
    extra = [c for c in feature_columns if c not in BASIC_COLUMNS]
    return high_risk(scored).select(*BASIC_COLUMNS, *extra)


def high_risk_extract(scored: DataFrame, feature_columns: list[str], rows: int = S.HIGH_RISK_EXTRACT_ROWS) -> DataFrame:
    """The top-k report: the ``rows`` high-risk customers with the highest probability (ties by id).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition
    keeps its own top rows, no full sort of the table.
    """
    return high_risk_customers(scored, feature_columns).orderBy(F.col(S.PROB).desc(), F.col(S.ID).asc()).limit(rows)


def _lines(df: DataFrame, section: str, lines: list[tuple[Column, Column]]) -> DataFrame:
    """(section, line_no, text) rows of ``lines`` = (number, text) per row of ``df``."""
    structs = [F.struct(n.cast("int").alias("line_no"), t.alias("text")) for n, t in lines]
    return df.select(F.lit(section).alias("section"), F.explode(F.array(*structs)).alias("l")).select("section", "l.line_no", "l.text")


def _said(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def report_lines(scored: DataFrame) -> DataFrame:
    """Lines of the text report: per plan segment (numbers and plan text) and the summary.

    Segment numbering follows the plan order of the segments present.
    Returns (section, line_no, text); ``write_report`` writes it as text.
    """
    plan = retention_plan(scored)
    pos = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("segment_id"))  # <= 5 rows
    p = plan.withColumn("pos", pos * 100)
    at = F.col("pos")
    title = F.concat(F.lit("Segment "), (at / 100).cast("int").cast("string"), F.lit(": "), F.col("segment"))
    seg_lines = _lines(p, "retention", [
        (at + 1, title),
        (at + 2, _said("Customer Count", fn.count_text("customer_count"))),
        (at + 3, _said("Average Churn Probability", fn.pct_text("avg_churn_probability"))),
        (at + 4, _said("Monthly Revenue At Risk", fn.money_text("monthly_revenue_at_risk"))),
        (at + 5, _said("Strategy", F.col("strategy"))),
        (at + 30, _said("Expected Impact", F.col("expected_impact"))),
        (at + 31, _said("Cost per Customer", F.col("cost_per_customer"))),
        (at + 32, _said("ROI", F.col("roi"))),
    ])
    items = p.select("pos", F.posexplode(F.split("action_items", S.ACTION_SEPARATOR)).alias("i", "item")).select(
        F.lit("retention").alias("section"), (at + 10 + F.col("i")).cast("int").alias("line_no"), F.concat(F.lit("  • "), F.col("item")).alias("text")
    )
    summary = _lines(revenue_at_risk(scored), "summary", [
        (F.lit(1), _said("Total High-Risk Customers", fn.count_text("high_risk_customers"))),
        (F.lit(2), _said("Total Monthly Revenue At Risk", fn.money_text("monthly_revenue_at_risk"))),
        (F.lit(3), _said("Annual Revenue At Risk", fn.money_text("annual_revenue_at_risk"))),
    ])
    return seg_lines.unionByName(items).unionByName(summary)


def _number(c: str) -> Column:
    return F.coalesce(F.regexp_replace(F.format_number(F.col(c).cast("double"), 4), ",", ""), F.lit("nan"))


def table_lines(evaluation: DataFrame, profile: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """Lines of the report's first sections: evaluation, top features (if given), segment tables.

    All three inputs are small results (five metrics, the features, the levels).
    """
    metric = F.array_position(F.array(*[F.lit(m) for m in S.METRIC_NAMES]), F.col("metric"))
    out = _lines(evaluation, "evaluation", [(metric, F.concat(F.col("metric"), F.lit(": "), _number("value")))])
    if importance is not None:
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("importance").desc(), "feature"))
        top = importance.withColumn("rank", rank).where(F.col("rank") <= S.TOP_FEATURES)
        out = out.unionByName(_lines(top, "features", [(F.col("rank"), F.concat(F.col("feature"), F.lit(": "), _number("importance")))]))
    dimension = F.array_position(F.array(*[F.lit(d) for d, _ in S.PROFILE_DIMENSIONS]), F.col("dimension"))
    level = F.row_number().over(Window.partitionBy("dimension").orderBy("level"))
    text = F.concat(
        F.col("dimension"), F.lit(" "), F.col("level"), F.lit(": "),
        F.concat_ws(", ", _number("actual_churn_rate"), _number("avg_churn_probability"), _number("avg_monthly_charges"),
                    F.col("customer_count").cast("string")),
    )
    numbered = profile.withColumn("no", dimension * 100 + level)
    return out.unionByName(_lines(numbered, "segments", [(F.col("no"), text)]))
