"""Model-backed plans: train once, keep the fitted model in the shared folder.

Training 300 boosted rounds is the expensive step of the workflow, and
several registered queries need the same model.  The fitted pipeline is
saved under the session's checkpoint folder (shared storage on a cluster)
keyed by a fingerprint of the input files and the hyper-parameters; later
queries (in this or another process) load it instead of training again.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import model as M
from churnlens.operators import split, stages
from churnlens.plans.tables import enriched, input_fingerprint
from churnlens.session import ensure_checkpoint_dir, path_exists
from churnlens.sources.subscribers import FIXTURE_COLUMNS

_MEMO: dict[tuple, M.FittedModel] = {}


def _code_version() -> str:
    """Hash of the code that defines the model's inputs and the learner, so a
    stored model is never reused after that code changes."""
    import inspect

    from churnlens import schema
    from churnlens.functions import columns
    from churnlens.operators import clean, features, quantile
    from churnlens.sources import subscribers

    text = "".join(inspect.getsource(m) for m in (schema, columns, clean, features, quantile, M, split, subscribers))
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def model_key(spark: SparkSession, sf_dir: str, params: M.GBTParams) -> str:
    raw = input_fingerprint(spark, sf_dir) + "|" + repr(M.params_key(params)) + "|" + _code_version()
    return hashlib.sha1(raw.encode()).hexdigest()[:20]


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched subscriber table (imputed totals, all derived features)."""
    return enriched(spark, sf_dir, totals=True)


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(subscribers(spark, sf_dir))


def fitted(
    spark: SparkSession, sf_dir: str, params: M.GBTParams = M.GBTParams(), refresh: bool = False
) -> M.FittedModel:
    """The fitted model for this input and parameters (``refresh`` retrains)."""
    key = model_key(spark, sf_dir, params)
    memo = (spark.sparkContext.applicationId, key)
    if memo in _MEMO and not refresh:
        return _MEMO[memo]
    path = _store(spark, sf_dir, params)
    meta_path = path + "/churnlens_meta"
    # the meta file is written last, so its marker says that the rest is whole
    if not refresh and path_exists(spark, meta_path + "/_SUCCESS"):
        meta = json.loads(spark.read.text(meta_path).first()[0])
        levels = M.Levels(spark.read.parquet(path + "/levels"), meta["sizes"], meta["few"])
        model = M.FittedModel(PipelineModel.load(path + "/pipeline"), meta["features"], meta["cats"], levels, meta["train_id"])
    else:
        df = subscribers(spark, sf_dir)
        sp = split.stratified_split(df)
        model = M.train(df, sp.where(F.col("split") == "train"), params, FIXTURE_COLUMNS)
        model.pipeline.write().overwrite().save(path + "/pipeline")
        model.levels.table.write.mode("overwrite").parquet(path + "/levels")
        model.levels.table = spark.read.parquet(path + "/levels")
        known = {"sizes": model.levels.sizes, "few": model.levels.few}
        meta = {"features": model.features, "cats": model.cats, **known, "train_id": model.train_id}
        row = spark.range(1).select(F.lit(json.dumps(meta)).alias("v"))
        row.coalesce(1).write.mode("overwrite").text(meta_path)
    _MEMO[memo] = model
    return model


def _store(spark: SparkSession, sf_dir: str, params: M.GBTParams) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "churnlens-models", model_key(spark, sf_dir, params))


def store_path(spark: SparkSession, sf_dir: str, params: M.GBTParams = M.GBTParams()) -> str:
    """Folder of this input's and these parameters' model and tables."""
    return _store(spark, sf_dir, params)


def scored_all(spark: SparkSession, sf_dir: str, params: M.GBTParams = M.GBTParams()) -> DataFrame:
    """Every subscriber scored (training and unlabelled rows included), with its split.

    Scored once per fitted model and written as Parquet next to the model in
    the shared folder; the segment, plan, extract and explanation reports
    all read that table (lineage cut, nothing recomputed, and a lost
    executor only re-reads files); partitioned by ``split``, so test metrics
    read the test rows only.
    """
    model = fitted(spark, sf_dir, params)
    path = _store(spark, sf_dir, params) + f"/scored-{model.train_id}"
    memo = (spark.sparkContext.applicationId, "scored", path)
    if memo not in _MEMO:
        if not path_exists(spark, path + "/_SUCCESS"):
            M.score(model, split_table(spark, sf_dir)).write.mode("overwrite").partitionBy("split").parquet(path)
        _MEMO[memo] = spark.read.parquet(path)
    return _MEMO[memo]


def scored_test(spark: SparkSession, sf_dir: str, params: M.GBTParams = M.GBTParams()) -> DataFrame:
    return scored_all(spark, sf_dir, params).where(F.col("split") == "test")


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain importances of the model, measured on the training rows of the given tables."""
    model = fitted(spark, sf_dir)
    return stages.gain_importance(split_table(spark, sf_dir).where(F.col("split") == "train"), model)


def tree_summary(model: M.FittedModel, spark: SparkSession) -> DataFrame:
    """One row per boosted tree: weight, node count, depth (model size bound)."""
    gbt = model.gbt
    rows = [(i, float(w), t.numNodes, t.depth) for i, (w, t) in enumerate(zip(gbt.treeWeights, gbt.trees))]
    return spark.createDataFrame(rows, "tree_id int, weight double, num_nodes int, depth int")


def model_feature_frame(df: DataFrame) -> DataFrame:
    """Id plus the model's input columns (the label and the raw text leave)."""
    return df.select(S.ID, *M.feature_columns(df, FIXTURE_COLUMNS))
