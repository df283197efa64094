"""Model: level codes, boosted-tree training, scoring, importances.

The learner is Spark ML's ``GBTClassifier`` (distributed histogram
aggregation per tree level).  Its inputs are prepared by plain column work:

* categorical values as text, missing -> 'nan', replaced by the 0-based rank
  of the level among the column's sorted levels (over the whole table, as the
  analysed workflow does).  The level table is a distinct + a rank by ranges
  (``ranking.py``) and is joined, so a column with any number of levels works;
  only columns counted
  to have at most ``FEW_LEVELS`` levels go as a literal map instead.  A level
  unknown to the model gets the next code;
* numbers as doubles; a missing number becomes ``MISSING`` (-1, below the
  domain of every count and charge), which keeps it apart from zero, and
  infinities become +-1e30.  The same at fit, score and explanation.

The trees split on code order (no nominal metadata).  MLlib samples rows per
partition, so the training rows are placed by hash of the id in a number of
partitions that follows from the parameters and the number of rows alone
(``n_partitions``) and sorted inside them: the fitted model does not depend on
the cluster or on how the input was cut.  Every labelled row is used to fit
(a caller may ask for a bound, ``max_rows``; no query does).

MLlib looks for its thresholds in a sample as soon as there are more rows than
``max_bins`` squared.  Then they are counted here instead, over all rows
(``thresholds``), and the learner gets the number of the bin a value is in: the
first stages of the pipeline find it, so the trees' thresholds are bin numbers
wherever the model goes.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import astuple, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens import schema as S
from churnlens.functions import churn_risk_band
from churnlens.operators.ranking import ranked
from churnlens.session import scratch_path

#: id, label and what the model itself adds; other columns are left out through ``exclude``
NOT_INPUTS = {S.ID, S.CHURN, S.LABEL, S.TOTAL_RAW, S.PROB, S.PRED, S.RISK_BAND, "split"}
MISSING = -1.0
LARGEST = 1e30
FEW_LEVELS = 100
WHOLE = 10_000  # rows of which MLlib reads all for its thresholds, whatever ``max_bins``
MOST_BINS = 46_340  # whose square MLlib can hold: beyond it (2.1 billion training rows) it draws rows again


@dataclass(frozen=True)
class GBTParams:
    rounds: int = S.GBT_ROUNDS
    step: float = S.GBT_STEP
    depth: int = S.GBT_DEPTH
    row_sample: float = S.GBT_ROW_SAMPLE
    column_sample: float = S.GBT_COLUMN_SAMPLE
    seed: int = S.GBT_SEED
    max_bins: int = S.GBT_MAX_BINS
    partitions: int = 4  # of the training rows, at least
    spread_rows: int = 45_000  # rows a partition of them has, up to ``spread`` partitions
    spread: int = 24
    most_rows: int = 250_000  # then they grow to this many rows, and only then in number
    max_rows: int | None = None  # labelled rows to fit at most (by id hash); None: all of them


def n_partitions(n: int, params: GBTParams) -> int:
    """Partitions of ``n`` training rows.

    Every tree level is a job over all of them, so their size sets the time of
    a round; each also starts a task and sends its histograms, so beyond
    ``spread`` their number grows slowly.
    """
    return max(params.partitions, min(params.spread, n // params.spread_rows), -(-n // params.most_rows))


def feature_columns(df: DataFrame, exclude=()) -> list[str]:
    """Model inputs: every column except id, label, the model's own outputs and ``exclude``."""
    return [c for c in df.columns if c not in NOT_INPUTS and c not in exclude]


def categorical_columns(df: DataFrame, features: list[str]) -> list[str]:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return [c for c in features if isinstance(types[c], T.StringType)]


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def level_table(df: DataFrame, cats: list[str]) -> DataFrame:
    """``(column, level, code)``: the levels of every categorical column and their 0-based rank."""
    texts = df.select(*[_text(c).alias(c) for c in cats]).unpivot([], cats, "column", "level").distinct()
    return ranked(texts, "column", "level", "code").withColumn("code", F.col("code").cast("int"))


@dataclass
class Levels:
    """Level codes of the categorical columns.

    Columns with at most ``FEW_LEVELS`` levels (counted first) carry them as a
    literal map in the plan; the others are joined to ``table``.
    """

    table: DataFrame
    sizes: dict[str, int]
    few: dict[str, list[str]]

    @classmethod
    def of(cls, table: DataFrame) -> Levels:
        sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        few: dict[str, list[str]] = {c: [] for c, n in sizes.items() if n <= FEW_LEVELS}
        for r in sorted(table.where(F.col("column").isin(*few)).collect(), key=lambda r: r["code"]) if few else []:
            few[r["column"]].append(r["level"])
        return cls(table, sizes, few)


def with_codes(df: DataFrame, cats: list[str], levels: Levels) -> DataFrame:
    """Add ``<column>__code`` (double); an unknown level gets the number of levels."""
    for c in cats:
        unknown = F.lit(float(levels.sizes.get(c, 0)))
        if c in levels.few:
            known = F.create_map(*[x for i, v in enumerate(levels.few[c]) for x in (F.lit(v), F.lit(float(i)))])
            df = df.withColumn(f"{c}__code", F.coalesce(F.try_element_at(known, _text(c)), unknown))
            continue
        own = levels.table.where(F.col("column") == c).select(F.col("level").alias(f"{c}__s"), F.col("code").cast("double").alias(f"{c}__c"))
        df = df.withColumn(f"{c}__s", _text(c)).join(own, f"{c}__s", "left").drop(f"{c}__s")
        df = df.withColumn(f"{c}__code", F.coalesce(f"{c}__c", unknown)).drop(f"{c}__c")
    return df


def label_encode(df: DataFrame, cats: list[str] | None = None, exclude=()) -> DataFrame:
    """``customer_id`` plus an integer code per categorical feature."""
    cats = cats or categorical_columns(df, feature_columns(df, exclude))
    out = with_codes(df, cats, Levels.of(level_table(df, cats)))
    return out.select(S.ID, *[F.col(f"{c}__code").cast("int").alias(c) for c in cats])


@dataclass
class FittedModel:
    pipeline: PipelineModel
    features: list[str]
    cats: list[str]
    levels: Levels
    train_id: str = field(default_factory=lambda: uuid.uuid4().hex[:16])

    @property
    def gbt(self):
        return self.pipeline.stages[-1]


def _number(c: str):
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)))


def prepared(df: DataFrame, features: list[str], cats: list[str], levels: Levels) -> DataFrame:
    """Rows with one finite double per feature (``<feature>__code`` or ``<feature>__num``)."""
    numbers = {f"{c}__num": _number(c) for c in features if c not in cats}
    coded = with_codes(df, cats, levels)
    return coded.withColumns(numbers) if numbers else coded


def thresholds(rows: DataFrame, inputs: list[str], max_bins: int) -> dict[str, list[float]]:
    """Where the learner may split each input: at most ``max_bins - 1`` places, all rows counted.

    MLlib's own rule, on every row: all places between two values if there are
    few enough, otherwise those nearest to the ``max_bins``-quantiles.  Values
    are counted, ranged and summed up range by range; a row per input and
    quantile comes to the driver.
    """
    spark = rows.sparkSession
    counted = rows.unpivot([], inputs, "input", "value").groupBy("input", "value").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "values")
    counted.repartitionByRange("input", "value").withColumn("range", F.spark_partition_id()).write.parquet(path)
    counted = spark.read.parquet(path)
    ranges = counted.groupBy("input", "range").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    before = Window.partitionBy("input").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranges.select(
        "input", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("values", "rows")]
    )
    inside = Window.partitionBy("input", "range").orderBy("value")
    placed = counted.join(F.broadcast(earlier), ["input", "range"]).select(
        "input",
        "value",
        (F.col("values_before") + F.row_number().over(inside) - 1).alias("place"),
        # twice the rows up to the middle of this value's own
        (2 * (F.col("rows_before") + F.sum("n").over(inside)) - F.col("n")).alias("middle"),
    )
    total = {r["input"]: r for r in ranges.groupBy("input").agg(F.sum("values").alias("values"), F.sum("rows").alias("rows")).collect()}
    n = max((r["rows"] for r in total.values()), default=1)
    passed = F.expr(f"({max_bins} * middle - 1) div {2 * n}")  # quantiles that are nearer to the place before the value
    first: dict[str, list] = {c: [] for c in inputs}
    some = placed.where("place > 0").groupBy("input", passed.alias("passed")).agg(F.min("place").alias("place"))
    for r in some.where("passed > 0").orderBy("input", "passed").collect():
        first[r["input"]].append((r["passed"], r["place"]))
    wanted = []
    for c in total:
        if total[c]["values"] <= max_bins:
            wanted += [(c, i) for i in range(1, total[c]["values"])]
            continue
        last, k = 0, 0
        for many, place in first[c]:
            while k < many:  # each quantile has a place of its own
                last, k = max(last + 1, place), k + 1
                if last < total[c]["values"]:
                    wanted.append((c, last))
    out: dict[str, list[float]] = {c: [] for c in inputs}
    if wanted:
        ends = spark.createDataFrame([(c, i, i - side) for c, i in wanted for side in (0, 1)], "input string, split long, place long")
        both = placed.join(F.broadcast(ends), ["input", "place"]).groupBy("input", "split").agg(F.min("value").alias("a"), F.max("value").alias("b"))
        for r in both.orderBy("input", "split").collect():
            middle = (r["a"] + r["b"]) / 2
            out[r["input"]].append(middle if middle < r["b"] else r["a"])
    return out


def train(df: DataFrame, train_rows: DataFrame, params: GBTParams = GBTParams(), exclude=()) -> FittedModel:
    """Levels from ``df`` (whole table), boosted trees from ``train_rows``."""
    spark = df.sparkSession
    features = feature_columns(df, exclude)
    cats = categorical_columns(df, features)
    path = scratch_path(spark, "levels")
    level_table(df, cats).write.parquet(path)
    levels = Levels.of(spark.read.parquet(path))
    labelled = train_rows.where(F.col(S.LABEL).isNotNull())
    n = labelled.count()
    if params.max_rows is not None and n > params.max_rows:
        unit = 1 << 30
        labelled = labelled.where(F.pmod(F.xxhash64(S.ID, F.lit(params.seed)), F.lit(unit)) < int(params.max_rows / n * unit))
        n = labelled.count()
    parts = n_partitions(n, params)
    row = F.xxhash64(*[F.col(c) for c in features])
    placed = prepared(labelled, features, cats, levels).repartition(parts, S.ID).sortWithinPartitions(S.ID, row)
    inputs = [f"{c}__code" if c in cats else f"{c}__num" for c in features]
    # each of the learner's jobs (one per tree level) sends the rows' whole lineage with every task;
    # a checkpoint keeps partitions and order and leaves files in the place of the plan
    placed = placed.select(S.LABEL, *inputs).checkpoint()
    bins, binned = params.max_bins, []
    if n > max(bins * bins, WHOLE):
        # bins of (a, b]; as many as MLlib needs to read all rows, of which it finds those that are there
        edges = [[-math.inf, *[math.nextafter(x, math.inf) for x in found], math.inf] for found in thresholds(placed, inputs, bins).values()]
        edges = [e if len(e) > 2 else [-math.inf, 0.0, math.inf] for e in edges]  # a constant input has no threshold
        numbers = ", ".join(f"int(`{c}__bin`) AS `{c}__place`" for c in inputs)  # a bin is no level: the cast drops that note
        binned = [
            Bucketizer(splitsArray=edges, inputCols=inputs, outputCols=[f"{c}__bin" for c in inputs]),
            SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__"),
        ]
        bins = min(MOST_BINS, max(bins, math.isqrt(n - 1) + 1))
    vector = VectorAssembler(inputCols=[f"{c}__place" for c in inputs] if binned else inputs, outputCol="features")
    gbt = GBTClassifier(
        featuresCol="features",
        labelCol=S.LABEL,
        maxIter=params.rounds,
        stepSize=params.step,
        maxDepth=params.depth,
        subsamplingRate=params.row_sample,
        featureSubsetStrategy=str(params.column_sample),
        seed=params.seed,
        lossType="logistic",
        maxBins=bins,
        cacheNodeIds=False,
        checkpointInterval=10,
    )
    pipeline = Pipeline(stages=[*binned, vector, gbt]).fit(placed)
    return FittedModel(pipeline, features, cats, levels)


def score(model: FittedModel, df: DataFrame, vectors: bool = False) -> DataFrame:
    """Input columns plus probability of churn, predicted class and risk band.

    ``vectors`` adds the assembled ``features`` and the ``margin`` that
    explanations need; stored tables leave them out.
    """
    keep = [c for c in df.columns if c not in (S.PROB, S.PRED, S.RISK_BAND)]
    out = model.pipeline.transform(prepared(df.select(*keep), model.features, model.cats, model.levels))
    more = [F.col("features"), vector_to_array("rawPrediction")[1].alias("margin")] if vectors else []
    return out.select(
        *keep,
        vector_to_array("probability")[1].alias(S.PROB),
        F.col("prediction").cast("int").alias(S.PRED),
        *more,
    ).withColumn(S.RISK_BAND, churn_risk_band(S.PROB))


def feature_importance(model: FittedModel, spark) -> DataFrame:
    """(feature, importance) sorted by importance; sums to 1.

    The importance vector has one entry per feature (a bound fixed by the
    schema), so it is built on the driver from the model.
    """
    imp = model.gbt.featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(model.features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), F.col("feature")
    )


def params_key(p: GBTParams) -> tuple:
    return astuple(p)
