"""Segment profiles of a scored table: churn rate, mean probability, mean charge, count.

All five dimensions are profiled in one pass: the five key columns are
unpivoted into (dimension, level) and one hash aggregate with map-side
partial aggregation groups them.  A level holding a third of the rows costs
one partial row per map task.  Null levels are dropped per dimension.
Binned dimensions list every bin, empty ones with count 0 and null means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import functions as fn
from churnlens import schema as S

_BINNED = {"Tenure": S.TENURE_LABELS, "MonthlyCharges": S.CHARGES_LABELS}


def _profile_aggs() -> list[Column]:
    r = S.METRIC_ROUND
    real = F.col("__real")
    return [
        F.bround(F.try_divide(F.count_if(fn.is_yes(S.CHURN) & real), F.count_if(real)), r).alias("actual_churn_rate"),
        F.bround(F.avg(S.PROB), r).alias("avg_churn_probability"),
        F.bround(F.avg(S.MONTHLY), r).alias("avg_monthly_charges"),
        F.count(S.ID).alias("customer_count"),
    ]


def _with_padding(long: DataFrame, dims: list[str]) -> DataFrame:
    """Add one flagged padding row per bin level of the binned dimensions.

    The padding rows (at most a dozen, a constant) make empty bins appear in
    the same aggregate pass, with count 0 and null measures, instead of a
    second pass joining the result against the bin list.
    """
    rows = [(d, lab) for d in dims if d in _BINNED for lab in _BINNED[d]]
    long = long.withColumn("__real", F.lit(True))
    if not rows:
        return long
    pad = fn.literal_table(long.sparkSession, ["dimension", "level"], rows).select(
        F.lit(None).cast("string").alias(S.ID),
        F.lit(None).cast("string").alias(S.CHURN),
        F.lit(None).cast("double").alias(S.PROB),
        F.lit(None).cast("double").alias(S.MONTHLY),
        "dimension",
        "level",
        F.lit(False).alias("__real"),
    )
    return long.unionByName(pad)


def segment_profile(scored: DataFrame, dimensions: list[tuple[str, str]] | None = None) -> DataFrame:
    """Long table (dimension, level, four measures) for the given dimensions."""
    dims = dimensions or S.PROFILE_DIMENSIONS
    keyed = scored.select(
        S.ID, S.CHURN, S.PROB, S.MONTHLY, *[F.col(c).cast("string").alias(name) for name, c in dims]
    )
    long = keyed.unpivot([S.ID, S.CHURN, S.PROB, S.MONTHLY], [n for n, _ in dims], "dimension", "level")
    long = _with_padding(long.where(F.col("level").isNotNull()), [n for n, _ in dims])
    return long.groupBy("dimension", "level").agg(*_profile_aggs())


def profile_by(scored: DataFrame, name: str) -> DataFrame:
    """One dimension's profile (a plain group-by on its key)."""
    col = dict(S.PROFILE_DIMENSIONS)[name]
    long = scored.where(F.col(col).isNotNull()).select(
        S.ID, S.CHURN, S.PROB, S.MONTHLY, F.lit(name).alias("dimension"), F.col(col).cast("string").alias("level")
    )
    return _with_padding(long, [name]).groupBy("dimension", "level").agg(*_profile_aggs())
