"""Scalar column expressions.

All of these return ``pyspark.sql.Column`` objects built from built-in
functions, so they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens import schema as S


NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c: str | Column) -> Column:
    """Text -> double; anything unparsable (blank, words) becomes null.

    A number is a decimal literal with optional sign and exponent, or an
    infinity; the pattern keeps out the suffixes that the JVM's own parser
    accepts (``1000d``, ``1000f``).  NaN is treated as missing, as a dataframe
    library would.
    """
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed binning: label i for ``edges[i] < x <= edges[i+1]``.

    The lowest edge is excluded and values outside the edges (or null)
    give null.  A chain of CASE branches, not ``Bucketizer`` (which is
    left-closed).
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    x = _col(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def cut_ordinal(c: str | Column, edges: Sequence[float]) -> Column:
    """0-based bin number of ``cut`` (null when unbinned)."""
    x = _col(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr


def tenure_group(c: str | Column = S.TENURE) -> Column:
    return cut(c, S.TENURE_EDGES, S.TENURE_LABELS)


def charges_group(c: str | Column = S.MONTHLY) -> Column:
    return cut(c, S.CHARGES_EDGES, S.CHARGES_LABELS)


def total_charges_group(c: str | Column = S.TOTAL) -> Column:
    return cut(c, S.TOTAL_EDGES, S.TOTAL_LABELS)


def churn_risk_band(c: str | Column = S.PROB) -> Column:
    return cut(c, S.RISK_BAND_EDGES, S.RISK_BAND_LABELS)


def risk_segment(contract: str | Column = S.CONTRACT, tenure: str | Column = S.TENURE) -> Column:
    """Low by default; month-to-month and tenure < 12 -> High, >= 12 -> Medium.

    Null tenure or contract fails both tests and stays Low.
    """
    mtm = _col(contract) == F.lit(S.MONTH_TO_MONTH)
    t = _col(tenure)
    return (
        F.when(mtm & (t < S.RISK_TENURE_CUTOFF), S.RISK_SEGMENTS[0])
        .when(mtm & (t >= S.RISK_TENURE_CUTOFF), S.RISK_SEGMENTS[1])
        .otherwise(S.RISK_SEGMENTS[2])
    )


def service_count(columns: Sequence[str] = S.SERVICE_COLUMNS) -> Column:
    """Number of service columns not in (No, No internet service).

    A missing value is not in that list, so it counts as a service.
    """
    terms = [
        F.coalesce(~F.col(c).isin(S.NO, S.NO_INTERNET), F.lit(True)).cast("int")
        for c in columns
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def high_value(monthly: str | Column = S.MONTHLY, contract: str | Column = S.CONTRACT) -> Column:
    """1 when monthly charges > 70 and contract is two-year, else 0."""
    cond = (_col(monthly) > S.HIGH_VALUE_CHARGE) & (_col(contract) == F.lit(S.TWO_YEAR))
    return F.coalesce(cond, F.lit(False)).cast("int")


def label_map(c: str | Column = S.CHURN) -> Column:
    """Yes -> 1, No -> 0, anything else -> null."""
    x = _col(c)
    return F.when(x == S.YES, 1).when(x == S.NO, 0)


def is_yes(c: str | Column = S.CHURN) -> Column:
    """Boolean 'churned'; null churn counts as not churned (but still counted)."""
    return F.coalesce(_col(c) == F.lit(S.YES), F.lit(False))


def display_name(title: str | Column) -> Column:
    """Short chart label: 'Streaming' -> 'Stream.', 'Online' -> 'Onl.'."""
    x = _col(title)
    for old, new in S.DISPLAY_REPLACEMENTS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def pct_text(c: str | Column, places: int = 2) -> Column:
    """Fraction -> percent text, e.g. 0.77621 -> '77.62%'.

    ``format_number`` rounds the exact binary value half-to-even, as Python
    string formatting does (``format_string('%.2f')`` rounds half-up on the
    shortest decimal form and differs on ties); grouping commas removed.
    """
    return F.concat(F.regexp_replace(F.format_number(_col(c) * 100, places), ",", ""), F.lit("%"))


def money_text(c: str | Column) -> Column:
    """Amount -> '$90,544.00'."""
    return F.concat(F.lit("$"), F.format_number(_col(c), 2))


def count_text(c: str | Column) -> Column:
    """Integer -> '1,124'."""
    return F.format_number(_col(c), 0)


def literal_table(spark, columns: Sequence[str], rows: Sequence[tuple]):
    """A small constant table built on the JVM (one-row range + ``inline``).

    ``createDataFrame`` on a Python list plans as a scan of a Python RDD,
    which needs Python workers to run; constant dimension tables (bins,
    plan text) do not.
    """

    def lit(v):
        if isinstance(v, (list, tuple)):
            return F.array(*[F.lit(x) for x in v])
        return F.lit(v)

    structs = [F.struct(*[lit(v).alias(c) for c, v in zip(columns, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
