"""Binary classification metrics: counts, confusion matrix, ROC curve, AUC.

Inputs are a label column (1/0) and a probability column; the predicted
class is ``probability > 0.5``.  Everything is aggregated before anything
is ordered:

* accuracy / precision / recall / F1 come from four conditional counts in
  one aggregate;
* ROC and AUC start from per-distinct-score counts (duplicates collapse in
  the map-side partial aggregate), then take cumulative sums with a
  two-level prefix: score buckets, cut at quantiles of the distinct scores so
  that scores crowded into a small interval still spread, get their offsets
  from a table of at most ``buckets`` rows (broadcast), and running sums are
  taken only inside a bucket.  No window runs over the whole table in one task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import schema as S

BUCKETS = 1024


def predicted(prob: str = S.PROB, threshold: float = S.PREDICT_THRESHOLD) -> Column:
    return (F.col(prob) > F.lit(threshold)).cast("int")


def score_counts(df: DataFrame, label: str = S.LABEL, prob: str = S.PROB) -> DataFrame:
    """(score, pos, neg) per distinct score: the one pass over the rows that
    every metric here is derived from (duplicate scores collapse in the
    map-side partial aggregate).  Reports that need several metrics build
    them from the same plan, so the exchange is computed once and reused."""
    y = F.col(label)
    return (
        df.where(y.isNotNull() & F.col(prob).isNotNull())
        .groupBy(F.col(prob).cast("double").alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )


def confusion_counts(df: DataFrame, label: str = S.LABEL, prob: str = S.PROB) -> DataFrame:
    """One row: n, tp, fp, fn, tn (predicted class: score > 0.5)."""
    s = score_counts(df, label, prob)
    hit = F.col("score") > F.lit(S.PREDICT_THRESHOLD)
    z = F.lit(0).cast("bigint")
    return s.agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), z).alias("n"),
        F.coalesce(F.sum(F.when(hit, F.col("pos")).otherwise(0)), z).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg")).otherwise(0)), z).alias("fp"),
        F.coalesce(F.sum(F.when(hit, 0).otherwise(F.col("pos"))), z).alias("fn"),
        F.coalesce(F.sum(F.when(hit, 0).otherwise(F.col("neg"))), z).alias("tn"),
    )


def _ratio(num: Column, den: Column) -> Column:
    # 0 when the denominator is 0 (zero-division convention of the metrics)
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _rates() -> list[Column]:
    """Accuracy, precision, recall and F1 (positive class 1) from the counts."""
    tp, fp, fn_, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return [_ratio(tp + tn, F.col("n")), _ratio(tp, tp + fp), _ratio(tp, tp + fn_), _ratio(2 * tp, 2 * tp + fp + fn_)]


def classification_metrics(df: DataFrame, label: str = S.LABEL, prob: str = S.PROB) -> DataFrame:
    """One row: counts plus accuracy, precision, recall and F1 (positive class 1)."""
    c = confusion_counts(df, label, prob)
    names = ("accuracy", "precision", "recall", "f1_score")
    return c.select("n", "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in zip(names, _rates())])


def confusion_matrix(df: DataFrame, label: str = S.LABEL, prob: str = S.PROB) -> DataFrame:
    """Long 2x2 matrix (actual, predicted, count); all four cells, also zeros."""
    c = confusion_counts(df, label, prob)
    return c.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("count")),
                F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("count")),
                F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("count")),
                F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("count")),
            )
        ).alias("c")
    ).select("c.actual", "c.predicted", "c.count")


def _score_points(df: DataFrame, label: str, prob: str, buckets: int) -> DataFrame:
    """Per distinct score (descending order): pos, neg, cumulative tps/fps,
    0-based position idx, the next point's pos/neg, and totals P, N."""
    s = score_counts(df, label, prob)
    # monotone bucket of the score (descending order of scores = descending buckets)
    probs = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(s.approxQuantile("score", probs, 0.5 / buckets))) if buckets > 1 else []
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) > 2:
        s = Bucketizer(splits=splits, inputCol="score", outputCol="__b").transform(s)
        s = s.withColumn("bucket", F.col("__b").cast("int")).drop("__b")
    else:
        s = s.withColumn("bucket", F.lit(0))
    b = s.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("b_rows"),
        F.sum("pos").alias("b_pos"),
        F.sum("neg").alias("b_neg"),
        F.max_by(F.struct("pos", "neg"), "score").alias("b_first"),
    )
    # at most buckets + 1 rows: one small window in a single task is bounded
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("bucket").desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offs = b.select(
        "bucket",
        F.coalesce(F.sum("b_rows").over(before), F.lit(0)).alias("idx_off"),
        F.coalesce(F.sum("b_pos").over(before), F.lit(0)).alias("pos_off"),
        F.coalesce(F.sum("b_neg").over(before), F.lit(0)).alias("neg_off"),
        F.lead("b_first").over(order).alias("next_first"),
        F.sum("b_pos").over(Window.partitionBy(F.lit(1))).alias("P"),
        F.sum("b_neg").over(Window.partitionBy(F.lit(1))).alias("N"),
    )
    inb = Window.partitionBy("bucket").orderBy(F.col("score").desc())
    run = inb.rowsBetween(Window.unboundedPreceding, 0)
    j = s.join(F.broadcast(offs), "bucket")
    return j.select(
        "score",
        "pos",
        "neg",
        (F.col("idx_off") + F.row_number().over(inb) - 1).alias("idx"),
        (F.col("pos_off") + F.sum("pos").over(run)).alias("tps"),
        (F.col("neg_off") + F.sum("neg").over(run)).alias("fps"),
        F.coalesce(F.lead("pos").over(inb), F.col("next_first.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inb), F.col("next_first.neg")).alias("next_neg"),
        "P",
        "N",
    )


def roc_curve(df: DataFrame, label: str = S.LABEL, prob: str = S.PROB, buckets: int = BUCKETS) -> DataFrame:
    """(threshold, fpr, tpr) with the origin (inf, 0, 0) first.

    One point per distinct score, collinear interior points dropped (a point
    stays when its neighbour's class counts differ, i.e. the slope changes).
    """
    pts = _score_points(df, label, prob, buckets)
    keep = (
        (F.col("idx") == 0)
        | F.col("next_pos").isNull()
        | (F.col("next_pos") != F.col("pos"))
        | (F.col("next_neg") != F.col("neg"))
    )
    curve = pts.where(keep).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fps").cast("double"), F.col("N").cast("double")).alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), F.col("P").cast("double")).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(curve)


def roc_auc(df: DataFrame, label: str = S.LABEL, prob: str = S.PROB, buckets: int = BUCKETS) -> DataFrame:
    """Area under the ROC curve by the rank-sum formula (ties count half).

    AUC = sum over scores of pos x (2 x negatives below + negatives at the
    score) / (2 P N), computed from the same per-score prefix sums.
    """
    return _score_points(df, label, prob, buckets).agg(*_auc_sums()).select(_auc().alias("auc"))


def _auc_sums() -> list[Column]:
    below = F.col("N") - F.col("fps")
    return [
        F.sum(F.col("pos").cast("double") * (2 * below + F.col("neg")).cast("double")).alias("num"),
        F.max("P").alias("n_pos"),
        F.max("N").alias("n_neg"),
    ]


def _auc() -> Column:
    return F.try_divide(F.col("num"), F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))


def evaluation_table(df: DataFrame, label: str = S.LABEL, prob: str = S.PROB, buckets: int = BUCKETS) -> DataFrame:
    """Five rows (metric, value): Accuracy, Precision, Recall, F1 Score, AUC (one aggregate over the score points)."""
    pts = _score_points(df, label, prob, buckets)
    hit = F.col("score") > F.lit(S.PREDICT_THRESHOLD)
    z = F.lit(0).cast("bigint")
    c = pts.agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), z).alias("n"),
        F.coalesce(F.sum(F.when(hit, F.col("pos")).otherwise(0)), z).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg")).otherwise(0)), z).alias("fp"),
        F.coalesce(F.sum(F.when(hit, 0).otherwise(F.col("pos"))), z).alias("fn"),
        F.coalesce(F.sum(F.when(hit, 0).otherwise(F.col("neg"))), z).alias("tn"),
        *_auc_sums(),
    )
    values = [*_rates(), _auc()]
    return c.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in zip(S.METRIC_NAMES, values)])
        ).alias("m")
    ).select("m.metric", "m.value")
