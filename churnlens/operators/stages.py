"""What the boosted trees do round by round, measured on the rows of a table.

The saved node table (bounded by rounds x (2 ^ (depth + 1) - 1) nodes, checked)
goes to the tasks, which route blocks of rows through all trees at once in
numpy.  Two results come out of that routing:

* ``learning_curve``: margins after every round are prefix sums over a row's
  tree outputs; equal scores of a round collapse, first over many blocks in the
  task, then in one aggregate, and the AUC of each round and split is an exact rank sum
  (``rank_sums``), the ROC area with ties counted half;
* ``gain_importance``: every row adds its count and its pseudo-residual to the
  nodes it passes; a split's gain is the squared-error reduction of those
  residuals, ``L^2 / n_L + R^2 / n_R - S^2 / n``, and a feature's importance is
  its mean gain per split, normalised (the gain definition of boosted trees).

Rows with a null label take no part.  A split (or table) without both
classes has a null AUC; a model without splits has no importances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import model as M
from churnlens.session import scratch_path, ship_package

BLOCK = 1024
POINTS = 1 << 22  # scores a task holds before equal ones collapse
SENT = 1 << 18  # points it sends at once
DIGIT = 16  # bits of a score that one level of the rank sum looks at


def node_table(gbt) -> DataFrame:
    """``tree, id, left, right, feature, threshold, output`` of every node, read from the saved model.

    ``feature`` is null in a leaf; ``output`` is the node's prediction times its tree's weight.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    gbt.write().overwrite().save(path)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in gbt.treeWeights]), F.col("treeID") + 1)
    inner = F.col("nodeData.leftChild") >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.when(inner, F.col("nodeData.split.featureIndex")).alias("feature"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        (F.col("nodeData.prediction") * weight).alias("output"),
    )


@dataclass
class Forest:
    """All nodes in flat arrays, ordered by tree and id; children are places in the arrays (a leaf's are its own)."""

    tree: np.ndarray
    id: np.ndarray
    root: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    output: np.ndarray
    depth: int

    @classmethod
    def of(cls, nodes: DataFrame, gbt) -> Forest:
        depth = gbt.getOrDefault("maxDepth")
        bound = len(gbt.treeWeights) * (2 ** (depth + 1) - 1)
        pdf = nodes.limit(bound + 1).toPandas().sort_values(["tree", "id"], ignore_index=True)
        if len(pdf) > bound:
            raise AssertionError(f"tree nodes exceed the parameter bound {bound}")
        root = np.searchsorted(pdf["tree"].to_numpy(), np.arange(len(gbt.treeWeights)))
        own = np.arange(len(pdf))
        place = {k: i for i, k in enumerate(zip(pdf["tree"], pdf["id"]))}
        child = lambda c: np.array([place.get(k, i) for i, k in enumerate(zip(pdf["tree"], pdf[c]))], np.int64)
        inner = pdf["feature"].notna().to_numpy()
        return cls(
            pdf["tree"].to_numpy(np.int64),
            pdf["id"].to_numpy(np.int64),
            root,
            np.where(inner, child("left"), own),
            np.where(inner, child("right"), own),
            pdf["feature"].fillna(0).to_numpy(np.int64),
            pdf["threshold"].fillna(np.inf).to_numpy(float),
            pdf["output"].to_numpy(float),
            depth,
        )

    def paths(self, x: np.ndarray):
        """Places (rows x trees) level by level, the roots first; a row that reached its leaf stays there."""
        at = np.broadcast_to(self.root, (len(x), len(self.root)))
        yield at
        flat, begin = x.ravel(), (np.arange(len(x)) * x.shape[1])[:, None]
        sides = np.stack((self.right, self.left), axis=1).ravel()
        for _ in range(self.depth):
            low = flat.take(begin + self.feature.take(at)) <= self.threshold.take(at)
            at = sides.take(2 * at + low)
            yield at

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margin of every row after every round (rows x trees)."""
        for at in self.paths(x):
            pass
        return np.cumsum(self.output[at], axis=1)


def _inputs(rows: DataFrame, model, *keep) -> DataFrame:
    """``keep`` columns, ``y`` (0 or 1) and the model's input vector ``x`` of the labelled rows."""
    ready = M.prepared(rows.where(F.col(S.LABEL).isNotNull()), model.features, model.cats, model.levels)
    for stage in model.pipeline.stages[:-1]:
        ready = stage.transform(ready)
    return ready.select(*keep, F.col(S.LABEL).cast("int").alias("y"), vector_to_array("features").alias("x"))


def _blocks(batches):
    for b in batches:
        for a in range(0, b.num_rows, BLOCK):
            part = b.slice(a, BLOCK)
            x = part.column("x")
            yield part, part.column("y").to_numpy(), x.flatten().to_numpy().reshape(part.num_rows, -1)


def ordered_bits(score: np.ndarray) -> np.ndarray:
    """int64 whose order is that of the doubles (-0.0 counts as 0.0)."""
    bits = (score.astype(np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def rank_sums(points: DataFrame, groups: list[str], digit: int = DIGIT) -> DataFrame:
    """``groups, auc`` from ``points(groups, key, pos, neg)``: exact, with ties counted half.

    Pairs are counted where their keys part: the points that agree in all but
    the last ``digit`` bits are one group of at most ``2 ** digit`` rows, whose
    pairs are summed in order; the group is then one point of the next level.
    So no task orders more than that many points of a group, wherever scores crowd.
    """
    p = points.groupBy(*groups, "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # pairs of a positive with a lower negative, plus half the tied ones
    p = p.withColumn("pairs", F.col("pos").cast("double") * F.col("neg") / 2)
    zero = F.struct(F.lit(0).cast("long").alias("neg"), F.lit(0.0).alias("pairs"))
    for left in range(64 - digit, -digit, -digit):
        up = (F.shiftright("key", digit) if left > 0 else F.lit(0).cast("long")).alias("key")
        children = F.array_sort(F.collect_list(F.struct("key", "pos", "neg", "pairs")))
        run = F.aggregate(
            "c",
            zero,
            lambda a, x: F.struct((a["neg"] + x["neg"]).alias("neg"), (a["pairs"] + x["pairs"] + x["pos"].cast("double") * a["neg"]).alias("pairs")),
        )
        p = p.groupBy(*groups, up).agg(children.alias("c"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        p = p.select(*groups, "key", "pos", "neg", run["pairs"].alias("pairs"))
    return p.select(*groups, F.try_divide(F.col("pairs"), F.col("pos").cast("double") * F.col("neg")).alias("auc"))


def score_points(batches, forest: Forest) -> Iterator[pa.RecordBatch]:
    """``split, round, key, pos, neg`` of blocks of rows: equal scores of a round collapse over about ``POINTS`` scores at a time."""
    names = ["split", "round", "key", "pos", "neg"]
    held: dict = {}  # split -> keys (rows x rounds) and classes of its rows, block by block
    n_held = 0

    def collapsed():
        for name, parts in sorted(held.items(), key=lambda h: str(h[0])):
            keys = np.concatenate([k for k, _ in parts]).T.copy()  # rounds x rows
            hits = np.concatenate([y for _, y in parts]) == 1
            order = np.argsort(keys, axis=1)
            s, hit = np.take_along_axis(keys, order, 1), hits[order]
            new = np.ones(s.shape, bool)
            new[:, 1:] = s[:, 1:] != s[:, :-1]
            first = np.flatnonzero(new.reshape(-1))
            pos = np.add.reduceat(hit.reshape(-1).astype(np.int64), first)
            n = np.diff(np.append(first, s.size))
            rounds, key = (first // s.shape[1] + 1).astype(np.int32), s.reshape(-1)[first]
            for a in range(0, len(first), SENT):
                z = min(a + SENT, len(first))
                split = pa.repeat(pa.scalar(name, pa.string()), z - a)
                yield pa.RecordBatch.from_arrays(
                    [split, pa.array(rounds[a:z]), pa.array(key[a:z]), pa.array(pos[a:z]), pa.array(n[a:z] - pos[a:z])], names=names
                )

    for part, y, x in _blocks(batches):
        keys = ordered_bits(1.0 / (1.0 + np.exp(-2.0 * forest.margins(x))))
        own = np.array(part.column("split").to_pylist(), object)
        for name in set(own.tolist()):
            mine = own == name
            held.setdefault(name, []).append((keys[mine], y[mine]))
        n_held += keys.size
        if n_held >= POINTS:
            yield from collapsed()
            held, n_held = {}, 0
    if n_held:
        yield from collapsed()


def learning_curve(rows: DataFrame, model, split: str = "split") -> DataFrame:
    """``round`` (from 1), ``split``, ``auc``: the AUC after every boosting round on every split of ``rows``."""
    ship_package(rows.sparkSession)
    forest = Forest.of(node_table(model.gbt), model.gbt)
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        return score_points(batches, sent.value)

    points = _inputs(rows, model, F.col(split).alias("split")).mapInArrow(run, "split string, round int, key long, pos long, neg long")
    return rank_sums(points, ["split", "round"]).select("round", "split", "auc")


def node_sums(rows: DataFrame, model, forest: Forest) -> DataFrame:
    """``tree, id, n, s``: rows and sum of pseudo-residuals at every node that ``rows`` reach.

    The first tree was fitted to the class (+-1), a later one to the negative
    gradient of the logistic loss at the margin before it.  Tasks add up in
    arrays of one entry per node.
    """
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        f = sent.value
        size = len(f.tree)
        n, s = np.zeros(size, np.int64), np.zeros(size)
        for _, y, x in _blocks(batches):
            levels = list(f.paths(x))
            margin = np.cumsum(f.output[levels[-1]], axis=1)
            sign = (2.0 * y - 1.0)[:, None]
            target = np.empty_like(margin)
            target[:, :1] = sign
            target[:, 1:] = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin[:, :-1]))
            before = None
            for at in levels:
                fresh = np.ones(at.shape, bool) if before is None else at != before
                n += np.bincount(at[fresh], minlength=size)
                s += np.bincount(at[fresh], weights=target[fresh], minlength=size)
                before = at
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(f.tree[used]), pa.array(f.id[used]), pa.array(n[used]), pa.array(s[used])], names=["tree", "id", "n", "s"]
        )

    sums = _inputs(rows, model).mapInArrow(run, "tree long, id long, n long, s double")
    return sums.groupBy("tree", "id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def split_gains(rows: DataFrame, model) -> DataFrame:
    """``tree, id, feature, gain`` of every split that ``rows`` reach on both sides."""
    nodes = node_table(model.gbt)
    sums = node_sums(rows, model, Forest.of(nodes, model.gbt))
    part = lambda side: sums.select("tree", F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("s").alias(f"s_{side}"))
    inner = nodes.where("feature is not null").join(sums, ["tree", "id"]).join(part("left"), ["tree", "left"]).join(part("right"), ["tree", "right"])
    square = lambda s, n: F.col(s) * F.col(s) / F.col(n)
    names = F.array(*[F.lit(f) for f in model.features])
    gain = square("s_left", "n_left") + square("s_right", "n_right") - square("s", "n")
    return inner.select("tree", "id", F.element_at(names, F.col("feature") + 1).alias("feature"), gain.alias("gain"))


def gain_importance(rows: DataFrame, model) -> DataFrame:
    """``feature, importance, total_gain, n_splits`` of all model inputs, most important first; importances sum to 1.

    ``importance`` is the mean gain of the feature's splits on ``rows`` over
    the sum of these means; a feature without splits has 0.
    """
    spark = rows.sparkSession
    every = spark.createDataFrame([(f,) for f in model.features], "feature string")
    each = split_gains(rows, model).groupBy("feature").agg(F.sum("gain").alias("total_gain"), F.count(F.lit(1)).alias("n_splits"))
    mean = F.coalesce(F.col("total_gain") / F.col("n_splits"), F.lit(0.0))
    full = every.join(F.broadcast(each), "feature", "left").withColumn("mean", mean)  # one row a feature on either side
    whole = full.agg(F.sum("mean").alias("whole"))
    share = F.coalesce(F.try_divide(F.col("mean"), F.col("whole")), F.lit(0.0))
    return (
        full.join(F.broadcast(whole), F.lit(True))
        .select("feature", share.alias("importance"), F.coalesce("total_gain", F.lit(0.0)).alias("total_gain"), F.coalesce("n_splits", F.lit(0)).cast("long").alias("n_splits"))
        .orderBy(F.col("importance").desc(), "feature")
    )
