"""Exact path-dependent TreeSHAP for the boosted-tree model, as a Spark job.

Per-row explanation is distributed with ``mapInPandas``: every task
explains its own partition.  What the tasks share is the tree ensemble,
read from the model's saved node table and broadcast; its size is bounded
by the model parameters (rounds x (2^(depth+1) - 1) nodes), not by the
data, and it is checked before broadcasting.

Maths (margin space, i.e. explaining ``rawPrediction[1]``).  For a leaf
with value v whose root path tests the set U of features (m = |U|), let
z_u be the product of cover fractions (child cover / parent cover) of the
splits on feature u and o_u(x) in {0, 1} whether x satisfies all of them.
The leaf's share of feature u's SHAP value is

    v (o_u - z_u) sum_k w(k) [t^k] prod_{s in U, s != u} (z_s + o_s t),
    w(k) = k! (m-1-k)! / m!,

the closed form of the path weights of the TreeSHAP recursion (duplicate
features on a path merge into one element with multiplied fractions).  The
product polynomial is built once per leaf and divided by (z_u + o_u t) per
feature (the "unwind" step).  All of it is vectorised over
(leaves x rows) blocks with numpy; summing over leaves and trees gives
phi, and base + sum(phi) equals the margin of every row.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import model as M
from churnlens.session import scratch_path, ship_package

LEAF_BLOCK = 1024
ROW_BLOCK = 64
ROWS_PER_TASK = 512
MAX_TASKS = 100_000


_TABLES: dict[tuple, tuple] = {}


def _leaf_tables(spark, gbt_model, n_features: int):
    """Leaf paths grouped by number of distinct features, plus the base value
    (built once per model instance and application)."""
    key = (spark.sparkContext.applicationId, gbt_model.uid, n_features)
    if key not in _TABLES:
        _TABLES[key] = _build_leaf_tables(spark, gbt_model, n_features)
    return _TABLES[key]


def _build_leaf_tables(spark, gbt_model, n_features: int):
    path = scratch_path(spark, "trees")
    gbt_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID",
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("pred"),
        F.col("nodeData.rawCount").cast("double").alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feat"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("thr"),  # leaves: empty
        F.col("nodeData.split.numCategories").alias("ncat"),
    )
    weights = list(gbt_model.treeWeights)
    depth = gbt_model.getOrDefault("maxDepth")
    bound = len(weights) * (2 ** (depth + 1) - 1)
    # flat scalar columns through Arrow; size bounded by `bound` (model size)
    pdf = nodes.limit(bound + 1).toPandas()
    if len(pdf) > bound:
        raise AssertionError(f"tree nodes exceed the parameter bound {bound}")
    if (pdf["ncat"].fillna(-1) > 0).any():
        raise ValueError("categorical splits are not expected (codes are ordered features)")
    trees: dict[int, dict[int, tuple]] = defaultdict(dict)
    for t, i, pred, cover, left, right, feat, thr in zip(
        pdf["treeID"], pdf["id"], pdf["pred"], pdf["cover"], pdf["left"], pdf["right"], pdf["feat"], pdf["thr"]
    ):
        trees[int(t)][int(i)] = (float(pred), float(cover), int(left), int(right), int(feat), float(thr))

    groups: dict[int, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    base = 0.0
    for t, nd in trees.items():
        w = weights[t]
        root_cover = nd[0][1]
        stack = [(0, {})]  # node id, feature -> [lo, hi, z]
        while stack:
            nid, conds = stack.pop()
            pred, cover, left, right, feat, thr = nd[nid]
            if left < 0:
                value = w * pred
                base += value * cover / root_cover
                m = len(conds)
                if m == 0:
                    continue
                g = groups[m]
                g["feat"].append([f for f in conds])
                g["lo"].append([conds[f][0] for f in conds])
                g["hi"].append([conds[f][1] for f in conds])
                g["z"].append([conds[f][2] for f in conds])
                g["v"].append(value)
                continue
            for child, is_left in ((left, True), (right, False)):
                c = {f: list(v) for f, v in conds.items()}
                lo, hi, z = c.get(feat, [-math.inf, math.inf, 1.0])
                if is_left:
                    hi = min(hi, thr)  # x <= thr goes left
                else:
                    lo = max(lo, thr)  # x > thr goes right
                z = z * nd[child][1] / cover
                c[feat] = [lo, hi, z]
                stack.append((child, c))
    tables = {
        m: {k: np.asarray(v, dtype=np.int32 if k == "feat" else np.float64) for k, v in g.items()}
        for m, g in groups.items()
    }
    return tables, base


def _shap_block(x: np.ndarray, tables: dict, n_features: int) -> np.ndarray:
    """phi (rows x features) for a block of rows x (rows x features)."""
    R = x.shape[0]
    phi = np.zeros((n_features, R))
    xt = x.T  # features x rows
    for m, g in tables.items():
        wk = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for s in range(0, len(g["v"]), LEAF_BLOCK):
            feat = g["feat"][s : s + LEAF_BLOCK]
            lo, hi, z = g["lo"][s : s + LEAF_BLOCK], g["hi"][s : s + LEAF_BLOCK], g["z"][s : s + LEAF_BLOCK]
            v = g["v"][s : s + LEAF_BLOCK]
            L = len(v)
            xv = xt[feat]  # L x m x R
            o = ((xv > lo[:, :, None]) & (xv <= hi[:, :, None])).astype(np.float64)
            # coefficients of prod_j (z_j + o_j t): L x (m+1) x R
            c = np.zeros((L, m + 1, R))
            c[:, 0, :] = 1.0
            for j in range(m):
                zj = z[:, j, None, None]
                nxt = c * zj
                nxt[:, 1:, :] += c[:, :-1, :] * o[:, j : j + 1, :]
                c = nxt
            w_all = np.einsum("k,lkr->lr", wk, c[:, :m, :])  # sum_k w_k c_k
            for u in range(m):
                zu, ou = z[:, u, None], o[:, u, :]
                # o_u = 1: divide by (z_u + t), accumulating sum_k w_k q_k from the top
                q = c[:, m, :]
                w1 = wk[m - 1] * q
                for k in range(m - 1, 0, -1):
                    q = c[:, k, :] - zu * q
                    w1 = w1 + wk[k - 1] * q
                # o_u = 0: divide by z_u
                wsum = np.where(ou > 0, w1, w_all / zu)
                contrib = v[:, None] * (ou - zu) * wsum  # L x R
                onehot = np.zeros((n_features, L))
                onehot[feat[:, u], np.arange(L)] = 1.0
                phi += onehot @ contrib
    return phi.T


def _explained(inp: DataFrame, model, kept: str) -> DataFrame:
    """``inp`` (kept columns, ``x``, ``margin``) with base value and phi of every row."""
    spark = inp.sparkSession
    ship_package(spark)
    n_features = len(model.features)
    tables, base = _leaf_tables(spark, model.gbt, n_features)
    shared = spark.sparkContext.broadcast(tables)
    names = [c for c in inp.columns if c not in ("x", "margin")]
    # written, so that the number of rows and the explanation share one scoring (and one shuffle)
    path = scratch_path(spark, "vectors")
    inp.write.parquet(path)
    inp = spark.read.parquet(path)

    def explain(batches):
        tabs = shared.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
            parts = [_shap_block(x[i : i + ROW_BLOCK], tabs, n_features) for i in range(0, len(x), ROW_BLOCK)]
            own = {c: pdf[c].to_numpy() for c in names}
            yield pd.DataFrame({**own, "base_value": base, "phi": list(np.vstack(parts)), "margin": pdf["margin"].to_numpy()})

    # explanation is CPU-bound per row, so partitions follow the number of rows, not their bytes
    parts = max(1, min(MAX_TASKS, -(-inp.count() // ROWS_PER_TASK)))
    return inp.repartition(parts).mapInPandas(explain, f"{kept}, base_value double, phi array<double>, margin double")


def shap_values(rows: DataFrame, model) -> DataFrame:
    """Per-row SHAP values: (customer_id, base_value, phi array, margin) of rows that carry the model's inputs."""
    scored = M.score(model, rows, vectors=True)
    inp = scored.select(S.ID, vector_to_array("features").alias("x"), "margin")
    return _explained(inp, model, f"{S.ID} string")


def shap_long(values: DataFrame, features: list[str]) -> DataFrame:
    """(customer_id, feature, phi) long form."""
    names = F.array(*[F.lit(f) for f in features])
    return values.select(S.ID, F.posexplode("phi").alias("pos", "phi")).select(
        S.ID, F.element_at(names, F.col("pos") + 1).alias("feature"), "phi"
    )


def shap_importance(rows: DataFrame, model) -> DataFrame:
    """Mean |SHAP value| per feature over all rows, descending.

    Rows with equal inputs have equal values, so every distinct vector is
    explained once and weighs as many rows as have it.
    """
    scored = M.score(model, rows, vectors=True).select(vector_to_array("features").alias("x"), "margin")
    distinct = scored.groupBy("x").agg(F.first("margin").alias("margin"), F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(f) for f in model.features])
    long = _explained(distinct, model, "n long").select("n", F.posexplode("phi").alias("pos", "phi"))
    return (
        long.groupBy(F.element_at(names, F.col("pos") + 1).alias("feature"))
        .agg((F.sum(F.abs("phi") * F.col("n")) / F.sum("n")).alias("mean_abs_shap"))
        .orderBy(F.col("mean_abs_shap").desc(), "feature")
    )
