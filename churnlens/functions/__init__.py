"""Column-level functions (built-in Spark expressions only)."""

from churnlens.functions.columns import (  # noqa: F401
    charges_group,
    churn_risk_band,
    count_text,
    cut,
    cut_ordinal,
    display_name,
    high_value,
    is_yes,
    label_map,
    literal_table,
    lenient_double,
    money_text,
    pct_text,
    risk_segment,
    service_count,
    tenure_group,
    total_charges_group,
)
