"""Exact median of a numeric column without funnelling the values through one task.

Spark's exact ``median``/``percentile`` aggregates merge a value -> count map
of every distinct value into a single final task.  Here the k-th smallest
value is found by digits: each pass groups the current value window into a
bounded number of buckets (a partial + final hash aggregate; only those rows
reach the driver), keeps the bucket that holds rank k, and stops when that
bucket holds a single distinct value or few enough rows (``finish_rows``) to be
ordered exactly.  A value that holds a third of all rows ends the search at
once (its bucket has min == max).

The digits: a first pass of ``buckets`` equal widths, which is all that
money-like data needs; then one pass over sign and binary exponent, exact also
for subnormal values; then equal widths inside that binade, which are digits
of the mantissa.  A pass takes log2(``buckets``) of its 52 bits, so with 4,096
buckets any column is done after seven passes, over however many decades its
values spread.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V = "__v"


def _binade(v: Column) -> Column:
    """Order-preserving digit of sign and exponent: 0 for zero, +-(1 + e + 1074) for 2^e <= |v| < 2^(e + 1)."""
    size = F.abs(v)
    near = F.floor(F.log2(size))
    # the logarithm may round across a power of two; powers of two themselves are exact
    low = F.when(F.pow(F.lit(2.0), near) > size, near - 1).otherwise(near)
    e = F.when((low < 1023) & (F.pow(F.lit(2.0), low + 1) <= size), low + 1).otherwise(low)
    return F.when(v == 0, F.lit(0)).otherwise((F.signum(v) * (e + 1075)).cast("int"))


def _exponent(x: float) -> int:
    return 0 if x == 0 else int(math.copysign(math.frexp(x)[1] + 1074, x))


def _digits(win: DataFrame, bucket: Column) -> list:
    """One pass: count, smallest and largest value per bucket, in order."""
    v = F.col(_V)
    rows = win.groupBy(bucket.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return sorted(rows.collect(), key=lambda r: r["b"])


def _kth(values: DataFrame, k: int, lo: float, hi: float, below: int, buckets: int, finish_rows: int) -> float:
    """k-th smallest (1-based) of ``values`` given it lies in [lo, hi] and
    ``below`` values are < lo."""
    v = F.col(_V)
    first = True
    while True:
        if lo == hi:
            return lo
        win = values.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
        width = hi / buckets - lo / buckets
        even = width > 0 and math.isfinite(width) and lo + width > lo
        if _exponent(lo) != _exponent(hi) and not (first and even):
            bucket = _binade(v)
        elif even:
            bucket = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1))
        else:  # fewer values than buckets are left between the two ends
            bucket = F.floor((v - F.lit(lo)) / F.lit(math.ulp(lo)))
        first = False
        cum = below
        for r in _digits(win, bucket):
            if cum + r["n"] >= k:
                if r["lo"] == r["hi"]:
                    return r["lo"]
                if r["n"] <= finish_rows:
                    # bounded by finish_rows: order the few remaining values exactly
                    part = (
                        win.where((v >= F.lit(r["lo"])) & (v <= F.lit(r["hi"])))
                        .orderBy(v)
                        .limit(k - cum)
                        .collect()
                    )
                    return part[-1][_V]
                lo, hi, below = r["lo"], r["hi"], cum
                break
            cum += r["n"]
        else:  # pragma: no cover - counts are consistent by construction
            raise AssertionError("rank outside the value window")


def exact_median(df: DataFrame, column: str, buckets: int = 4096, finish_rows: int = 20_000) -> float | None:
    """Exact median of the non-null values of ``column`` (midpoint for even n).

    Runs a handful of small jobs; the single projected column is persisted
    (memory and disk) for the passes and released afterwards.  A lost
    executor only costs recomputation of its cached blocks.
    """
    values = df.select(F.col(column).cast("double").alias(_V)).where(F.col(_V).isNotNull() & ~F.isnan(_V))
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    low, high = F.col(_V) == F.lit(-math.inf), F.col(_V) == F.lit(math.inf)
    try:
        finite = values.where(~low & ~high)
        st = values.agg(
            F.count_if(low).alias("n_low"),
            F.count_if(high).alias("n_high"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(~low & ~high, F.col(_V))).alias("lo"),
            F.max(F.when(~low & ~high, F.col(_V))).alias("hi"),
        ).first()
        n, n_low, n_finite = st["n"], st["n_low"], st["n"] - st["n_low"] - st["n_high"]
        if n == 0:
            return None

        def kth(k: int) -> float:
            # infinities stand at the ends; only finite values are bucketed
            if k <= n_low:
                return -math.inf
            if k > n_low + n_finite:
                return math.inf
            return _kth(finite, k - n_low, st["lo"], st["hi"], 0, buckets, finish_rows)

        k = (n + 1) // 2
        v1 = kth(k)
        if n % 2 == 1:
            return v1
        if not math.isfinite(v1) or k + 1 > n_low + n_finite:
            return (v1 + kth(k + 1)) / 2.0
        nxt = finite.agg(
            F.count_if(F.col(_V) <= F.lit(v1)).alias("le"),
            F.min(F.when(F.col(_V) > F.lit(v1), F.col(_V))).alias("next"),
        ).first()
        v2 = v1 if nxt["le"] + n_low >= k + 1 else nxt["next"]
        return (v1 + v2) / 2.0
    finally:
        values.unpersist()
