import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators.quantile import exact_median


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_median_matches_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = (rng.integers(-5000, 5000, n) * 0.25).tolist()
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    assert exact_median(df, "x", buckets=4, finish_rows=3) == pytest.approx(float(np.median(vals)), abs=0)


def test_median_skewed_and_nulls(spark):
    # a third of the rows share one value; nulls are skipped
    vals = [7.5] * 400 + [float(i) for i in range(800)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ref = float(np.median([v for v in vals if v is not None]))
    assert exact_median(df, "x", buckets=8, finish_rows=5) == ref


def test_median_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_median(df, "x") is None


def test_median_wide_range(spark):
    vals = [1e-300, 3.0, 5e300, -2e300, 0.0, 17.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_median(df, "x", buckets=4, finish_rows=1) == float(np.median(vals))


def test_infinities_stand_at_the_ends(spark):
    import math

    inf = math.inf
    for values, want in (
        ([1.0, 2.0, inf], 2.0), ([-inf, 1.0, 2.0], 1.0), ([1.0, inf], inf), ([-inf, 5.0, 7.0, inf], 6.0), ([inf], inf), ([-inf, -inf, 1.0], -inf),
    ):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert exact_median(df, "x") == want
    assert math.isnan(exact_median(spark.createDataFrame([(-inf,), (inf,)], "x double"), "x"))


def _passes(monkeypatch):
    from churnlens.operators import quantile

    seen, real = [], quantile._digits
    monkeypatch.setattr(quantile, "_digits", lambda win, bucket: seen.append(1) or real(win, bucket))
    return seen


def test_median_over_many_decades_takes_at_most_seven_passes(spark, monkeypatch):
    seen = _passes(monkeypatch)
    rng = np.random.default_rng(4)
    for vals in (
        np.exp(rng.uniform(-700, 700, 4001)),
        -np.exp(rng.uniform(-700, 700, 4001)),
        rng.standard_normal(4001) * 10.0 ** rng.integers(-300, 300, 4001),
        1.0 + np.arange(4001) * 2.0**-52,
        np.arange(4001) * 5e-324,
        np.concatenate((np.full(1000, -1e308), np.nextafter(8.0, 0) - np.arange(2001) * 2.0**-50, np.full(1000, 1e308))),
    ):
        seen.clear()
        df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(4)
        assert exact_median(df, "x", finish_rows=1) == float(np.median(vals))
        assert len(seen) <= 7


def test_binade_is_exact_at_powers_of_two(spark):
    from churnlens.operators.quantile import _binade, _exponent

    vals = [s * x for e in range(-1074, 1024, 7) for x in (2.0**e, np.nextafter(2.0**e, 0), np.nextafter(2.0**e, np.inf)) for s in (1.0, -1.0)]
    vals += [2.0**-1022, np.nextafter(2.0**-1022, 0), 2.0**1023, np.nextafter(np.inf, 0), 0.0, -0.0]
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, x double").select("i", _binade(F.col("x")).alias("b")).collect()
    assert {r["i"]: r["b"] for r in got} == {i: _exponent(float(v)) for i, v in enumerate(vals)}
