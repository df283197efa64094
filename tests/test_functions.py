from pyspark.sql import functions as F

from churnlens import functions as fn
from churnlens import schema as S


def test_cut_is_right_closed_and_excludes_lowest_edge(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.5, 12.0, 12.5, 100.0, 100.5, None]], "x double")
    got = [r["g"] for r in df.select(fn.tenure_group("x").alias("g")).collect()]
    assert got == [None, "0-12", "0-12", "13-24", "61+", None, None]
    ords = [r["o"] for r in df.select(fn.cut_ordinal("x", S.TENURE_EDGES).alias("o")).collect()]
    assert ords == [None, 0, 0, 1, 5, None, None]


def test_lenient_double(spark):
    df = spark.createDataFrame([(" 12.5 ",), (" ",), ("abc",), ("NaN",), ("0",), (None,)], "s string")
    got = [r["v"] for r in df.select(fn.lenient_double("s").alias("v")).collect()]
    assert got == [12.5, None, None, None, 0.0, None]


def test_text_formats_round_like_python(spark):
    vals = [0.77625, 0.026750000000000003, 1086528.0, 60792.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select(fn.pct_text("x").alias("p"), fn.money_text("x").alias("m")).collect()
    for v, r in zip(vals, rows):
        assert r["p"] == f"{v:.2%}"
        assert r["m"] == f"${v:,.2f}"
    n = spark.range(1).select(fn.count_text(F.lit(1124)).alias("c")).first()["c"]
    assert n == f"{1124:,}"


def test_display_names(spark):
    df = spark.createDataFrame([(t,) for t in S.SERVICE_TITLES], "t string")
    got = [r["d"] for r in df.select(fn.display_name("t").alias("d")).collect()]
    assert got == [t.replace("Streaming", "Stream.").replace("Online", "Onl.") for t in S.SERVICE_TITLES]


def test_literal_table_is_jvm_side(spark):
    t = fn.literal_table(spark, ["a", "b", "c"], [(1, "x", ["p", "q"]), (2, "y", ["r"])])
    assert [tuple(r) for r in t.collect()] == [(1, "x", ["p", "q"]), (2, "y", ["r"])]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "PythonRDD" not in plan


def test_service_count_counts_missing(spark):
    row = [None, "No", "No internet service", "Yes", "maybe", "No"]
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{c} string" for c in S.SERVICE_COLUMNS))
    assert df.select(fn.service_count().alias("n")).first()["n"] == 3


def test_lenient_double_takes_numbers_only(spark):
    texts = ["1000", " 1.5 ", "-2e3", ".5", "5.", "inf", "-Infinity", "1000d", "1000f", "0x1p3", "1,000", "nan", "", " ", "abc", None]
    want = [1000.0, 1.5, -2000.0, 0.5, 5.0, float("inf"), float("-inf")] + [None] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["v"] for r in df.select("i", fn.lenient_double("t").alias("v")).orderBy("i").collect()]
    assert got == want
