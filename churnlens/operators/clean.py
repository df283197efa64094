"""Cleaning: lenient numeric cast, missing count, median imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions import lenient_double
from churnlens.operators.quantile import exact_median


def parse_total_charges(df: DataFrame, raw: str = S.TOTAL_RAW, out: str = "total_charges_parsed") -> DataFrame:
    """Add the leniently parsed total (unparsable text -> null, never an error)."""
    return df.withColumn(out, lenient_double(raw))


def missing_count(df: DataFrame, raw: str = S.TOTAL_RAW) -> DataFrame:
    """Number of totals that are missing after the lenient cast (one aggregate)."""
    return df.agg(
        F.count_if(lenient_double(raw).isNull()).alias("missing_total_charges"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def impute_total_charges(df: DataFrame, raw: str = S.TOTAL_RAW, median: float | None = None) -> DataFrame:
    """Parse the total, fill missing values and zeros with the median.

    The median is taken over the parsed non-null values including zeros;
    filling with it leaves it unchanged, so one value serves both steps.
    It is computed exactly by ``exact_median`` (a few small jobs) unless
    given, e.g. when scoring new data with the median learned at training.
    """
    parsed = parse_total_charges(df, raw, "__tc")
    if median is None:
        median = exact_median(parsed, "__tc")
    tc = F.col("__tc")
    filled = F.when(tc.isNull() | (tc == 0), F.lit(median).cast("double")).otherwise(tc)
    return parsed.withColumn(S.TOTAL, filled).drop("__tc")
