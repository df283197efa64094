import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import metrics, split
from churnlens.plans import modelling as MP

from conftest import SF_CHECK


def test_split_exact_per_class(spark):
    df = MP.subscribers(spark, SF_CHECK)
    sp = split.stratified_split(df).cache()
    per = {(r[S.LABEL], r["split"]): r["n"] for r in sp.groupBy(S.LABEL, "split").agg(F.count("*").alias("n")).collect()}
    for lab in (0, 1):
        n = per.get((lab, "test"), 0) + per.get((lab, "train"), 0)
        assert per[(lab, "test")] == int(np.floor(n * 0.2 + 0.5))
    assert sp.count() == df.count() == sp.select(S.ID).distinct().count()


def test_split_independent_of_search_and_partitions(spark):
    df = MP.subscribers(spark, SF_CHECK)
    a = split.stratified_split(df, digits=1, finish_rows=1).select(S.ID, F.col("split").alias("a"))
    b = split.stratified_split(df.repartition(64)).select(S.ID, F.col("split").alias("b"))
    c = split.stratified_split(df.coalesce(1), digits=8).select(S.ID, F.col("split").alias("c"))
    j = a.join(b, S.ID).join(c, S.ID)
    assert j.count() == df.count()
    assert j.where("a <> b OR a <> c").count() == 0


def test_split_does_not_shuffle_rows(spark):
    df = MP.subscribers(spark, SF_CHECK)
    plan = split.stratified_split(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def _frame(spark, labels, probs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in zip(labels, probs)], f"{S.LABEL} int, {S.PROB} double")


def test_golden_counts(spark):
    # the counts behind the published digits: TN 922, FP 113, FN 180, TP 194
    rows = [(0, 0.1)] * 922 + [(0, 0.9)] * 113 + [(1, 0.1)] * 180 + [(1, 0.9)] * 194
    m = metrics.classification_metrics(_frame(spark, *zip(*rows))).first()
    assert round(m["accuracy"], 6) == 0.792051
    assert round(m["precision"], 6) == 0.631922
    assert round(m["recall"], 6) == 0.518717
    assert round(m["f1_score"], 6) == 0.569750


def _brute(labels, probs):
    y, p = np.array(labels), np.array(probs)
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def _roc_brute(labels, probs):
    y, p = np.array(labels), np.array(probs)
    th = np.unique(p)[::-1]
    tps = np.array([(y[p >= t] == 1).sum() for t in th])
    fps = np.array([(y[p >= t] == 0).sum() for t in th])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True] if len(th) > 2 else np.ones(len(th), bool)
    pts = [(np.inf, 0.0, 0.0)] + [(t, f / (y == 0).sum(), tp / (y == 1).sum()) for t, f, tp in zip(th[keep], fps[keep], tps[keep])]
    return pts


@pytest.mark.parametrize("buckets", [3, 4096])
def test_roc_and_auc_against_brute_force(spark, buckets):
    rng = np.random.default_rng(3)
    probs = np.round(rng.random(500), 2)  # many ties
    labels = (rng.random(500) < probs).astype(int)
    df = _frame(spark, labels, probs)
    auc = metrics.roc_auc(df, buckets=buckets).first()["auc"]
    assert auc == pytest.approx(_brute(labels, probs), abs=1e-12)
    got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in metrics.roc_curve(df, buckets=buckets).collect()), reverse=True)
    want = sorted(_roc_brute(labels, probs), reverse=True)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w)


def test_confusion_matrix_has_all_cells(spark):
    df = _frame(spark, [1, 1], [0.9, 0.8])
    cells = {(r["actual"], r["predicted"]): r["count"] for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def _counts(sp):
    return {(r["churn_label"], r["split"]): r["n"] for r in sp.groupBy("churn_label", "split").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("seed", [42, 53])
def test_split_with_hot_duplicated_key(spark, seed):
    # one id holds a third of the rows (copies differ in another column)
    rows = [("hot", i % 2, float(i)) for i in range(3000)] + [(f"c{i}", int(i % 3 == 0), float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "customer_id string, churn_label int, v double")
    results = []
    for parts in (1, 8, 64):
        sp = split.stratified_split(df.repartition(parts), seed=seed, finish_rows=100).cache()
        assert sp.count() == len(rows)
        per = _counts(sp)
        for lab in (0, 1):
            n = per.get((lab, "test"), 0) + per.get((lab, "train"), 0)
            assert per.get((lab, "test"), 0) == int(np.floor(n * 0.2 + 0.5))
        results.append({tuple(r) for r in sp.collect()})
    assert results[0] == results[1] == results[2]


def test_split_with_exact_copies_at_the_cut(spark):
    # a third of the table is one copied row; every seed puts some cut near or inside it
    rows = [("hot", 1, 1.0)] * 3000 + [(f"c{i}", 1, float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "customer_id string, churn_label int, v double")
    inside = 0
    for seed in range(6):
        sp = split.stratified_split(df, seed=seed).cache()
        assert sp.count() == 9000 and _counts(sp)[(1, "test")] == 1800
        inside += sp.where("customer_id = 'hot'").select("split").distinct().count() == 2
    assert inside


def test_split_keeps_unlabelled_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 0), ("d", 1), ("e", 1), (None, 1)], "customer_id string, churn_label int")
    got = {r["customer_id"]: r["split"] for r in split.stratified_split(df).collect()}
    assert len(got) == 6 and got["a"] is None and None not in [v for k, v in got.items() if k != "a"]
    assert split.stratified_split(df.limit(0)).count() == 0


def test_split_reads_id_and_label_only_to_find_the_cut(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias(S.ID), (F.col("id") % 2).cast("int").alias(S.LABEL), F.lit("text").alias("note"))
    out = split.stratified_split(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "structstojson" not in plan.lower()
    assert _counts(out.withColumnRenamed(S.LABEL, "churn_label")) == {(0, "test"): 500, (0, "train"): 2000, (1, "test"): 500, (1, "train"): 2000}


def test_split_of_few_and_of_one_row(spark):
    one = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 0)], f"{S.ID} string, {S.LABEL} int")
    assert _counts(split.stratified_split(one).withColumnRenamed(S.LABEL, "churn_label")) == {(1, "train"): 1, (0, "test"): 1, (0, "train"): 2}
