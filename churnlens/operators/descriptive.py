"""Descriptive attrition aggregates: counts, shares, rates, crosstab, services.

Semantics kept from the analysed workflow:
* a null group key is dropped (a dataframe group-by drops it, Spark keeps it);
* a rate is churned rows / all rows of the group x 100, where rows whose
  churn value is missing still count in the denominator;
* binned keys show every bin, empty ones with zero counts and a null rate.

Every aggregate here is a hash aggregate with map-side partial
aggregation, so a key holding a third of the rows costs one partial row
per map task.  Small fixed dimensions (bins, Yes/No) are joined only
after aggregation, when both sides have a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import functions as fn
from churnlens import schema as S

CHURN_LEVELS = [S.NO, S.YES]


def _rate(yes: Column, n: Column) -> Column:
    """yes / n x 100, null for an empty group (ANSI-safe division)."""
    return F.try_divide(yes.cast("double"), n.cast("double")) * 100


def _bin_dimension(df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    return fn.literal_table(df.sparkSession, [key, f"{key}_order"], [(lab, i) for i, lab in enumerate(labels)])


def churn_distribution(df: DataFrame) -> DataFrame:
    """Customers per churn value and their share (%) of the shown rows."""
    g = df.where(F.col(S.CHURN).isNotNull()).groupBy(S.CHURN).agg(F.count(F.lit(1)).alias("customers"))
    # the window runs over the aggregated result (one row per churn value)
    total = F.sum("customers").over(Window.partitionBy(F.lit(1)))
    return g.select(S.CHURN, "customers", (F.col("customers") / total * 100).alias("share_pct"))


def churn_revenue(df: DataFrame) -> DataFrame:
    """Monthly revenue per churn value and its share (%)."""
    g = df.where(F.col(S.CHURN).isNotNull()).groupBy(S.CHURN).agg(F.sum(S.MONTHLY).alias("monthly_revenue"))
    total = F.sum("monthly_revenue").over(Window.partitionBy(F.lit(1)))
    return g.select(S.CHURN, "monthly_revenue", (F.col("monthly_revenue") / total * 100).alias("share_pct"))


def churn_counts_by(df: DataFrame, key: str) -> DataFrame:
    """Customers per key x churn, churn values as columns (n_no, n_yes), zero filled.

    Rows with a missing key or churn value are left out (as a two-key
    group-by does).  Explicit pivot values make this one aggregate.
    """
    return (
        df.where(F.col(key).isNotNull() & F.col(S.CHURN).isin(*CHURN_LEVELS))
        .groupBy(key)
        .agg(
            F.count_if(F.col(S.CHURN) == S.NO).alias("n_no"),
            F.count_if(F.col(S.CHURN) == S.YES).alias("n_yes"),
        )
    )


def churn_rate_by(df: DataFrame, key: str) -> DataFrame:
    """Customers and churn rate (%) per key; null keys dropped."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("customers"), F.count_if(fn.is_yes(S.CHURN)).alias("churned"))
        .select(key, "customers", _rate(F.col("churned"), F.col("customers")).alias("churn_rate_pct"))
    )


def _with_all_bins(agg: DataFrame, key: str, labels: list[str], zero_cols: list[str]) -> DataFrame:
    dim = _bin_dimension(agg, key, labels)
    out = dim.join(agg, key, "left")
    fills = {c: 0 for c in zero_cols}
    return out.na.fill(fills)


def charges_churn_count(df: DataFrame) -> DataFrame:
    return churn_counts_by(df, S.MONTHLY)


def contract_churn_count(df: DataFrame) -> DataFrame:
    return churn_counts_by(df, S.CONTRACT)


def tenure_churn_count(df: DataFrame) -> DataFrame:
    """Tenure-group x churn counts with all six bins (empty ones zero)."""
    agg = churn_counts_by(df, S.TENURE_GROUP)
    return _with_all_bins(agg, S.TENURE_GROUP, S.TENURE_LABELS, ["n_no", "n_yes"])


def charges_churn_rate(df: DataFrame) -> DataFrame:
    return churn_rate_by(df, S.MONTHLY)


def contract_churn_rate(df: DataFrame) -> DataFrame:
    return churn_rate_by(df, S.CONTRACT)


def tenure_churn_rate(df: DataFrame) -> DataFrame:
    """Churn rate per tenure group with all six bins (empty: 0 customers, null rate)."""
    agg = churn_rate_by(df, S.TENURE_GROUP)
    return _with_all_bins(agg, S.TENURE_GROUP, S.TENURE_LABELS, ["customers"])


def internet_churn_crosstab(df: DataFrame) -> DataFrame:
    """Row-normalised crosstab internet service x churn, in %.

    Pairs with a missing side are dropped; each row sums to 100.
    """
    c = churn_counts_by(df, S.INTERNET)
    total = (F.col("n_no") + F.col("n_yes")).cast("double")
    return c.select(
        S.INTERNET,
        (F.col("n_no") / total * 100).alias("no_pct"),
        (F.col("n_yes") / total * 100).alias("yes_pct"),
    )


def service_churn_rate(df: DataFrame) -> DataFrame:
    """Churn per service x level (Yes/No) in long form, one scan for all six.

    The six service columns are unpivoted (an Expand feeding the partial
    aggregate in the same stage), the 'No internet service' level and
    missing values are filtered out, and one group-by produces the
    12 (service, level) rows: customers, churned, churn rate %, plus the
    short display name and file key of the service.
    """
    titles = dict(zip(S.SERVICE_COLUMNS, S.SERVICE_TITLES))
    long = df.select(S.CHURN, *S.SERVICE_COLUMNS).unpivot(
        [S.CHURN], S.SERVICE_COLUMNS, "service", "level"
    )
    agg = (
        long.where(F.col("level").isin(S.YES, S.NO))
        .groupBy("service", "level")
        .agg(F.count(F.lit(1)).alias("customers"), F.count_if(fn.is_yes(S.CHURN)).alias("churned"))
    )
    title = F.col("service")
    for name, t in titles.items():
        title = F.when(F.col("service") == name, F.lit(t)).otherwise(title)
    return agg.select(
        "service",
        "level",
        "customers",
        "churned",
        _rate(F.col("churned"), F.col("customers")).alias("churn_rate_pct"),
        fn.display_name(title).alias("display_name"),
        F.lower(title).alias("file_key"),
    )


def _service_wide(long: DataFrame, value: str) -> DataFrame:
    # pivot of the 12-row long table: level rows x six service columns
    return long.groupBy("level").pivot("service", S.SERVICE_COLUMNS).agg(F.first(value))


def service_rate_wide(df: DataFrame) -> DataFrame:
    """Churn rate % per level (rows No/Yes) x service (columns)."""
    return _service_wide(service_churn_rate(df), "churn_rate_pct")


def service_count_wide(df: DataFrame) -> DataFrame:
    """Churned customers per level (rows No/Yes) x service (columns)."""
    return _service_wide(service_churn_rate(df), "churned")
