"""Learning curve and gain importance against plain numpy."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import metrics, split, stages
from churnlens.operators import model as M
from churnlens.plans import modelling as MP
from churnlens.sources.subscribers import FIXTURE_COLUMNS

from conftest import SF_CHECK


@pytest.fixture(scope="module")
def eight(spark):
    df = MP.subscribers(spark, SF_CHECK).cache()
    rows = split.stratified_split(df).cache()
    model = M.train(df, rows.where("split = 'train'"), M.GBTParams(rounds=8, depth=3), FIXTURE_COLUMNS)
    flat = M.score(model, rows, vectors=True).select("split", S.LABEL, vector_to_array("features").alias("x"), "margin").toPandas()
    return model, rows, flat


def _auc(score, y):
    """Every pair of a positive and a negative, ties half."""
    p, n = score[y == 1], score[y == 0]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def _walk(trees, x):
    """Outputs per tree and the nodes passed, one row at a time from the trees' own text nodes."""
    out, seen = [], []
    for t in range(len(trees)):
        i, passed = 0, []
        while True:
            passed.append(i)
            left, right, feature, threshold, output = trees[t][i]
            if feature is None:
                break
            i = left if x[feature] <= threshold else right
        out.append(output)
        seen.append(passed)
    return out, seen


def _trees(model):
    trees = {}
    for r in stages.node_table(model.gbt).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = (r["left"], r["right"], r["feature"], r["threshold"], r["output"])
    return trees


def test_learning_curve_equals_brute_force_and_ends_at_the_models_auc(spark, eight):
    model, rows, flat = eight
    got = {(r["round"], r["split"]): r["auc"] for r in stages.learning_curve(rows, model).collect()}
    assert set(got) == {(k, s) for k in range(1, 9) for s in ("train", "test")}
    trees = _trees(model)
    margin = np.cumsum([_walk(trees, x)[0] for x in flat["x"]], axis=1)
    assert np.allclose(margin[:, -1], flat["margin"])
    y = flat[S.LABEL].to_numpy()
    for (k, s), auc in got.items():
        mine = (flat["split"] == s).to_numpy()
        assert auc == pytest.approx(_auc(1 / (1 + np.exp(-2 * margin[mine, k - 1])), y[mine]), abs=1e-9)
    test = M.score(model, rows.where("split = 'test'"))
    assert got[8, "test"] == pytest.approx(metrics.roc_auc(test).first()["auc"], abs=1e-9)


def test_gain_importance_equals_a_hand_computation(spark, eight):
    _, rows, flat = eight
    df = MP.subscribers(spark, SF_CHECK)
    train = rows.where("split = 'train'")
    model = M.train(df, train, M.GBTParams(rounds=3, depth=2), FIXTURE_COLUMNS)
    trees = _trees(model)
    use = flat[flat["split"] == "train"]
    sums = {}
    for x, y in zip(use["x"], use[S.LABEL]):
        sign, margin = 2 * y - 1, 0.0
        out, seen = _walk(trees, x)
        for t in range(3):
            target = sign if t == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
            for i in seen[t]:
                n, s = sums.get((t, i), (0, 0.0))
                sums[t, i] = (n + 1, s + target)
            margin += out[t]
    gains = {}
    for t in trees:
        for i, (left, right, feature, _, _) in trees[t].items():
            if feature is not None and (t, left) in sums and (t, right) in sums:
                part = lambda k: sums[k][1] ** 2 / sums[k][0]
                gains.setdefault(feature, []).append(part((t, left)) + part((t, right)) - part((t, i)))
    means = {f: np.mean(g) for f, g in gains.items()}
    got = stages.gain_importance(train, model).collect()
    assert sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert [r["feature"] for r in got] == [r["feature"] for r in sorted(got, key=lambda r: (-r["importance"], r["feature"]))]
    by_name = {r["feature"]: r for r in got}
    assert set(by_name) == set(model.features)
    for f, name in enumerate(model.features):
        assert by_name[name]["importance"] == pytest.approx(means.get(f, 0.0) / sum(means.values()))
        assert by_name[name]["total_gain"] == pytest.approx(sum(gains.get(f, [0.0])))
        assert by_name[name]["n_splits"] == len(gains.get(f, []))


def test_curve_of_rows_without_labels_or_one_class(spark, eight):
    model, rows, _ = eight
    none = rows.withColumn(S.LABEL, F.lit(None).cast("int"))
    assert stages.learning_curve(none, model).count() == 0
    one = stages.learning_curve(rows.where(f"{S.LABEL} = 1"), model)
    assert one.where("auc is not null").count() == 0 and one.count() == 16
    assert sum(r["importance"] for r in stages.gain_importance(none, model).collect()) == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.5, -0.5, 0.0, -0.0, 1e-300, 5e-324, 0.25, 0.25000000000000006, 1e300]), st.booleans()), min_size=1, max_size=30))
def test_rank_sums_are_exact(spark, pairs):
    score, y = np.array([s for s, _ in pairs]), np.array([int(b) for _, b in pairs])
    keys = stages.ordered_bits(score).tolist()
    points = spark.createDataFrame([("g", k, int(b), 1 - int(b)) for k, b in zip(keys, y)], "g string, key long, pos long, neg long")
    got = stages.rank_sums(points, ["g"]).first()["auc"]
    assert (got is None) if y.min() == y.max() else got == pytest.approx(_auc(score, y), abs=1e-12)


def test_equal_scores_collapse_over_many_blocks():
    """A task sent its equal scores once a block of 1,024 rows; now it collapses many blocks before it sends."""
    one = lambda *v: np.array(v)
    # two trees of one split each: x <= 0 to the left
    forest = stages.Forest(
        one(0, 0, 0, 1, 1, 1), one(0, 1, 2, 0, 1, 2), one(0, 3), one(1, 1, 2, 4, 4, 5), one(2, 1, 2, 5, 4, 5),
        np.zeros(6, np.int64), one(0.0, np.inf, np.inf, 0.0, np.inf, np.inf), one(0.0, -1.0, 1.0, 0.0, -0.5, 0.5), 1,
    )
    n = 5 * stages.BLOCK
    x = np.where(np.arange(n) % 3 == 0, -1.0, 1.0)
    y = (np.arange(n) % 2).astype(np.int32)
    split = np.where(np.arange(n) % 5 == 0, "test", "train")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(x))
    batch = pa.RecordBatch.from_arrays([pa.array(split), pa.array(y), lists], names=["split", "y", "x"])
    got = [r for b in stages.score_points([batch.slice(0, 3000), batch.slice(3000)], forest) for r in b.to_pylist()]
    assert len(got) == 2 * 2 * 2  # splits x rounds x distinct scores
    want = {}
    for k in range(n):
        for r, m in enumerate((np.sign(x[k]), 1.5 * np.sign(x[k])), 1):
            key = int(stages.ordered_bits(1.0 / (1.0 + np.exp(-2.0 * one(m))))[0])
            pn = want.setdefault((split[k], r, key), [0, 0])
            pn[1 - y[k]] += 1
    assert {(g["split"], g["round"], g["key"]): [g["pos"], g["neg"]] for g in got} == want


def test_a_task_holds_few_scores(monkeypatch):
    """What is held is bounded, and what is sent in parts adds up."""
    monkeypatch.setattr(stages, "POINTS", 2 * stages.BLOCK)
    monkeypatch.setattr(stages, "SENT", 100)
    one = lambda *v: np.array(v)
    forest = stages.Forest(one(0), one(0), one(0), one(0), one(0), one(0), one(np.inf), one(0.25), 1)
    n = 7 * stages.BLOCK + 5
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.zeros(n)))
    batch = pa.RecordBatch.from_arrays([pa.array([None] * n, pa.string()), pa.array(np.ones(n, np.int32)), lists], names=["split", "y", "x"])
    out = list(stages.score_points([batch], forest))
    assert sum(b.num_rows for b in out) == 4 and max(b.num_rows for b in out) <= 100
    assert sum(sum(b.column("pos").to_pylist()) for b in out) == n
    assert all(v is None for b in out for v in b.column("split").to_pylist())
