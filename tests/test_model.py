"""Model invariants on a small model (few rounds, shallow trees)."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import explain as X
from churnlens.operators import metrics, split
from churnlens.operators import model as M
from churnlens.plans import modelling as MP
from churnlens.sources.subscribers import FIXTURE_COLUMNS

from conftest import SF_CHECK, SF_SMALL

PARAMS = M.GBTParams(rounds=4, depth=3)


@pytest.fixture(scope="module")
def fitted(spark):
    df = MP.subscribers(spark, SF_CHECK).cache()
    sp = split.stratified_split(df).cache()
    model = M.train(df, sp.where("split = 'train'"), PARAMS, FIXTURE_COLUMNS)
    test = M.score(model, sp.where("split = 'test'"), vectors=True).cache()
    return model, df, test


def test_importances_sum_to_one(fitted, spark):
    model, _, _ = fitted
    imp = M.feature_importance(model, spark).collect()
    assert len(imp) == len(model.features)
    assert all(r["importance"] >= 0 for r in imp)
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)


def test_scores_are_probabilities(fitted):
    _, _, test = fitted
    r = test.agg(F.min(S.PROB).alias("lo"), F.max(S.PROB).alias("hi"), F.count("*").alias("n")).first()
    assert 0.0 <= r["lo"] <= r["hi"] <= 1.0 and r["n"] > 0
    # prediction is probability > 0.5
    assert test.where((F.col(S.PROB) > 0.5).cast("int") != F.col(S.PRED)).count() == 0


def test_confusion_cells_sum_to_test_rows(fitted):
    _, _, test = fitted
    cells = metrics.confusion_matrix(test).collect()
    assert sum(r["count"] for r in cells) == test.count()


def test_feature_columns_exclude_label_and_ids(fitted):
    model, _, _ = fitted
    assert not set(model.features) & {S.ID, S.CHURN, S.LABEL, "k", "score", S.TOTAL_RAW}
    assert S.TOTAL in model.features and S.RISK_SEGMENT in model.features


def test_codes_are_ordered_not_nominal(fitted):
    model, df, _ = fitted
    out = M.score(model, df.limit(5), vectors=True)
    meta = out.schema["features"].metadata
    attrs = meta.get("ml_attr", {}).get("attrs", {})
    assert "nominal" not in attrs  # trees split on code order


def test_shap_additive(fitted):
    model, _, test = fitted
    vals = X.shap_values(test.drop("features", "margin"), model).toPandas()
    assert len(vals) == test.count()
    total = vals["base_value"] + np.stack(vals["phi"].to_numpy()).sum(axis=1)
    assert np.abs(total - vals["margin"]).max() < 1e-9


def _cond_exp(tree, nid, x, subset):
    n = tree[nid]
    if n["leftChild"] < 0:
        return n["prediction"]
    f, thr = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
    if f in subset:
        return _cond_exp(tree, n["leftChild"] if x[f] <= thr else n["rightChild"], x, subset)
    lft, rgt = tree[n["leftChild"]], tree[n["rightChild"]]
    return (lft["rawCount"] * _cond_exp(tree, n["leftChild"], x, subset)
            + rgt["rawCount"] * _cond_exp(tree, n["rightChild"], x, subset)) / n["rawCount"]


def test_shap_equals_brute_force_shapley(fitted, spark, tmp_path):
    model, _, test = fitted
    path = str(tmp_path / "gbt")
    model.gbt.write().overwrite().save(path)
    trees = {}
    for r in spark.read.parquet(path + "/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    weights = model.gbt.treeWeights
    tables, _ = X._leaf_tables(spark, model.gbt, len(model.features))
    rows = test.select(vector_to_array("features").alias("x")).limit(2).collect()
    for row in rows:
        x = np.array(row["x"])
        phi = np.zeros(len(x))
        for t, tree in trees.items():
            used = sorted({n["split"]["featureIndex"] for n in tree.values() if n["leftChild"] >= 0})
            m = len(used)
            for u in used:
                others = [f for f in used if f != u]
                for k in range(m):
                    wk = math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m)
                    for sub in itertools.combinations(others, k):
                        s = set(sub)
                        phi[u] += weights[t] * wk * (_cond_exp(tree, 0, x, s | {u}) - _cond_exp(tree, 0, x, s))
        fast = X._shap_block(x[None, :], tables, len(x))[0]
        assert np.abs(fast - phi).max() < 1e-12


def _edge(df):
    """Every tenth row without a number, some without a label, some infinite."""
    k = F.pmod(F.xxhash64(S.ID), F.lit(10))
    return (
        df.withColumn(S.TENURE, F.when(k == 0, None).otherwise(F.col(S.TENURE)))
        .withColumn(S.TOTAL, F.when(k == 1, float("inf")).otherwise(F.col(S.TOTAL)))
        .withColumn(S.LABEL, F.when(k == 2, None).otherwise(F.col(S.LABEL)))
        .withColumn(S.CONTRACT, F.when(k == 3, None).otherwise(F.col(S.CONTRACT)))
    )


@pytest.fixture(scope="module")
def edge(spark):
    df = _edge(MP.subscribers(spark, SF_SMALL)).cache()
    sp = split.stratified_split(df).cache()
    model = M.train(df, sp.where("split = 'train'"), PARAMS, FIXTURE_COLUMNS)
    return model, df, sp


def test_missing_numbers_train_and_every_row_is_scored(edge):
    model, df, sp = edge
    scored = M.score(model, sp)
    assert scored.count() == df.count() and scored.where(F.col(S.PROB).isNull()).count() == 0
    assert scored.where("split is null").count() == df.where(F.col(S.LABEL).isNull()).count() > 0


def test_shap_additive_with_missing_numbers(edge):
    model, df, _ = edge
    vals = X.shap_values(df, model).toPandas()
    total = vals["base_value"] + np.stack(vals["phi"].to_numpy()).sum(axis=1)
    assert len(vals) == df.count() and np.abs(total - vals["margin"]).max() < 1e-9


def test_shap_importance_of_distinct_vectors_equals_that_of_rows(edge, spark):
    model, df, _ = edge
    twice = df.unionAll(df.limit(40))
    want = X.shap_long(X.shap_values(twice, model), model.features).groupBy("feature").agg(F.avg(F.abs("phi")).alias("m"))
    want = {r["feature"]: r["m"] for r in want.collect()}
    got = {r["feature"]: r["mean_abs_shap"] for r in X.shap_importance(twice, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_model_does_not_depend_on_input_partitions(edge):
    _, df, _ = edge
    params = M.GBTParams(rounds=3, depth=3)
    probs = []
    for parts in (1, 8):
        x = df.repartition(parts)
        sp = split.stratified_split(x)
        model = M.train(x, sp.where("split = 'train'"), params, FIXTURE_COLUMNS)
        probs.append({r[S.ID]: r[S.PROB] for r in M.score(model, df).select(S.ID, S.PROB).collect()})
    assert max(abs(probs[0][k] - probs[1][k]) for k in probs[0]) < 1e-9


def test_user_columns_are_inputs_unless_excluded(spark):
    df = spark.createDataFrame([("a", 1.0, 2)], f"{S.ID} string, score double, k int")
    assert M.feature_columns(df) == ["score", "k"] and M.feature_columns(df, ("k",)) == ["score"]


def test_fit_rows_bound(spark):
    df = MP.subscribers(spark, SF_CHECK)
    model = M.train(df, split.stratified_split(df).where("split = 'train'"), M.GBTParams(rounds=1, depth=2, max_rows=300), FIXTURE_COLUMNS)
    nodes = model.gbt.trees[0]
    assert nodes.numNodes >= 1


def test_explanations_score_once(fitted):
    model, _, test = fitted
    out = X.shap_importance(test.drop("features", "margin"), model)
    files = out.inputFiles()
    assert files and all("vectors" in f for f in files)  # the written distinct vectors, nothing is scored again
    assert len(out.collect()) == len(model.features)


def test_training_rows_spread_over_more_tasks_as_they_grow(spark, monkeypatch):
    """A tree level is one pass over all partitions: with four of them more rows and cores did not meet."""
    p = M.GBTParams()
    assert [M.n_partitions(n, p) for n in (0, 72_000, 224_999, 720_000, 2_000_000, 60_000_000)] == [4, 4, 4, 16, 24, 240]
    seen = []
    fit = M.Pipeline.fit
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    df = MP.subscribers(spark, "/root/testdata/sf0.001")
    rows = split.stratified_split(df).where("split = 'train'")
    M.train(df, rows, M.GBTParams(rounds=1, depth=2, spread_rows=10), FIXTURE_COLUMNS)
    assert seen == [min(24, rows.where("churn_label is not null").count() // 10)]


def test_training_jobs_carry_no_plan_of_the_rows(spark, monkeypatch):
    """The learner runs a job per tree level; each of their tasks took the whole lineage of the rows along."""
    seen = []
    fit = M.Pipeline.fit
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    df = MP.subscribers(spark, "/root/testdata/sf0.001")
    rows = split.stratified_split(df).where("split = 'train'")
    M.train(df, rows, M.GBTParams(rounds=1, depth=2), FIXTURE_COLUMNS)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "Exchange" not in plan and "FileScan" not in plan
    # the checkpoint keeps the placement: ids' hash partitions, sorted inside
    assert seen[0].rdd.getNumPartitions() == M.GBTParams().partitions
    assert seen[0].count() == rows.where("churn_label is not null").count()


def test_every_labelled_row_is_fitted(spark, monkeypatch):
    """More than two million rows: the trees were fitted on a hash sample of them."""
    n, seen = 2_200_000, []
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, rows: seen.append(rows.count()))
    rows = spark.range(n).select(F.col("id").cast("string").alias(S.ID), F.lit("a").alias("kind"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias(S.LABEL))
    M.train(rows.limit(10), rows, M.GBTParams(rounds=1, depth=1))
    assert seen == [n]


def _mllib_thresholds(values, max_bins):
    """MLlib's walk over the sorted values of all rows."""
    v, n = np.unique(values, return_counts=True)
    if len(v) <= max_bins:
        return [(a + b) / 2 for a, b in zip(v, v[1:])]
    stride = len(values) / max_bins
    out, target, run = [], stride, n[0]
    for i in range(1, len(v)):
        before, run = run, run + n[i]
        if abs(before - target) < abs(run - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return out


def test_thresholds_count_all_rows(spark):
    rng = np.random.default_rng(4)
    n = 4_000
    cols = {
        "wide": rng.normal(size=n).round(2),
        "heavy": np.where(rng.random(n) < 0.6, 7.0, rng.integers(0, 90, n)).astype(float),
        "tail": np.where(rng.random(n) < 0.97, -1.0, rng.random(n) * 1e6),
        "few": (rng.random(n) < 0.001) * 3.0,
        "one": np.full(n, 2.5),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())], ", ".join(f"{c} double" for c in cols)).repartition(7)
    for bins in (4, 32):
        found = M.thresholds(df, list(cols), bins)
        assert found == {c: _mllib_thresholds(v, bins) for c, v in cols.items()}


def _with_rare(spark, n):
    """Each value of x but zero on one row, with a label of its own."""
    x = F.when(F.col("id") < 12, F.col("id")).otherwise(0).cast("double")
    label = F.when(F.col("id") < 12, F.col("id") % 2).otherwise(0).cast("int")
    return spark.range(n).select(F.col("id").cast("string").alias(S.ID), F.lit("a").alias("kind"), x.alias("x"), (F.col("id") % 4001).cast("double").alias("y"), label.alias(S.LABEL))


def test_thresholds_of_the_trees_do_not_come_from_a_sample(spark):
    """MLlib drew 10,000 of these rows for its thresholds and so left values of x without one."""
    df = _with_rare(spark, 40_000)
    params = M.GBTParams(rounds=1, step=1.0, depth=12, row_sample=1.0, column_sample=1.0, max_bins=16)
    model = M.train(df, df, params)
    got = {r["x"]: r["hit"] for r in M.score(model, df.where("x > 0")).select("x", (F.col(S.PRED) == F.col(S.LABEL)).alias("hit")).collect()}
    assert got == {float(i): True for i in range(1, 12)}


def test_counted_thresholds_give_the_learners_own_trees(spark, monkeypatch):
    """Where MLlib reads all rows itself, both ways fit the same model; the reports read its bins."""
    from churnlens.operators import stages

    df = MP.subscribers(spark, SF_SMALL)
    rows = split.stratified_split(df)
    params = M.GBTParams(rounds=3, depth=3, max_bins=10)
    results = []
    for whole in (M.WHOLE, 0):
        monkeypatch.setattr(M, "WHOLE", whole)
        model = M.train(df, rows.where("split = 'train'"), params, FIXTURE_COLUMNS)
        scores = {r[S.ID]: r[S.PROB] for r in M.score(model, df).select(S.ID, S.PROB).collect()}
        curve = {(r["round"], r["split"]): r["auc"] for r in stages.learning_curve(rows.where("split is not null"), model).collect()}
        gains = {r["feature"]: r["importance"] for r in stages.gain_importance(rows.where("split = 'train'"), model).collect()}
        shap = {r["feature"]: r["mean_abs_shap"] for r in X.shap_importance(rows.where("split = 'test'"), model).collect()}
        results.append((len(model.pipeline.stages), scores, curve, gains, shap))
    (plain, *one), (counted, *two) = results
    assert (plain, counted) == (2, 4)
    for a, b in zip(one, two):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
