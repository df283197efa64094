"""Every driver-side collection is bounded by a checked limit."""

from pyspark.sql import functions as F

from churnlens.operators import model as M
from churnlens.operators import quantile


def test_label_encode_takes_any_number_of_levels(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("customer_id"),
                                    F.format_string("v%05d", F.col("id")).alias("code"))
    out = M.label_encode(df, ["code"])
    assert out.where(F.col("code") != F.col("customer_id").cast("int")).count() == 0 and out.count() == 20_000


def test_median_finish_collect_is_bounded(spark, monkeypatch):
    seen = []
    real = quantile._kth

    def spy(values, k, lo, hi, below, buckets, finish_rows):
        seen.append(finish_rows)
        return real(values, k, lo, hi, below, buckets, finish_rows)

    monkeypatch.setattr(quantile, "_kth", spy)
    df = spark.range(10_000).select((F.col("id") * 0.25).alias("x"))
    assert quantile.exact_median(df, "x", buckets=16, finish_rows=100) == (4999 * 0.25 + 5000 * 0.25) / 2
    assert seen == [100]


def test_tree_table_bound(spark):
    from churnlens.operators import explain as X

    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    gbt = GBTClassifier(maxIter=3, maxDepth=2).fit(d)
    tables, base = X._leaf_tables(spark, gbt, 1)
    leaves = sum(len(t["v"]) for t in tables.values())
    assert leaves <= 3 * 2 ** 2


def test_model_key_follows_input_files(spark, tmp_path):
    import shutil

    from churnlens.operators.model import GBTParams
    from churnlens.plans.modelling import model_key

    src = "/root/testdata/sf0.001"
    for t in ("customer", "orders"):
        shutil.copy(f"{src}/{t}.parquet", tmp_path / f"{t}.parquet")
    k1 = model_key(spark, str(tmp_path), GBTParams())
    assert k1 == model_key(spark, str(tmp_path), GBTParams())
    assert k1 != model_key(spark, str(tmp_path), GBTParams(rounds=10))
    spark.read.parquet(f"{src}/orders.parquet").limit(10).write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert k1 != model_key(spark, str(tmp_path), GBTParams())
