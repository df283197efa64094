"""Distributed ranks of levels, and the label codes made from them."""

from pyspark.sql import functions as F

from churnlens.operators import model as M
from churnlens.operators.ranking import ranked


def test_ranks_by_ranges_equal_plain_ranks(spark):
    rows = [("a", f"v{i % 97:03d}{i}") for i in range(700)] + [("b", w) for w in ("", "é", "z", "Z", "~", "a b")] + [("c", "only")]
    df = spark.createDataFrame(rows, "g string, v string")
    for n in ("1", "3", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {(r["g"], r["v"]): r["rank"] for r in ranked(df.repartition(5), "g", "v").collect()}
        assert got == {(g, v): i for g in "abc" for i, v in enumerate(sorted((v for h, v in rows if h == g), key=str.encode))}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert ranked(df.limit(0), "g", "v").count() == 0


def test_a_million_levels_and_no_window_over_a_whole_column(spark):
    df = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("customer_id"), F.format_string("v%07d", F.col("id")).alias("code"), F.lit("x").alias("same")
    )
    table = M.level_table(df, ["code", "same"])
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line and "windowspecdefinition" in line]
    assert windows and all("range#" in line.split("windowspecdefinition")[1] for line in windows)
    out = M.label_encode(df, ["code", "same"])
    assert out.where((F.col("code") != F.col("customer_id").cast("int")) | (F.col("same") != 0)).count() == 0
    assert out.count() == 1_000_000
