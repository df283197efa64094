"""Incremental scoring of arriving subscriber snapshots (Structured Streaming).

The same cleaning, feature and model stages as the batch path, applied to
a file stream.  A stream cannot take a global median per micro-batch, so
the imputation median learned on the training table is passed in; every
other step is row-local, so the query is stateless and each micro-batch is
a narrow map.  Progress is kept in ``checkpoint_location`` (shared
storage), so a restarted query resumes without re-scoring committed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from churnlens import schema as S
from churnlens.operators import model as M
from churnlens.operators.features import enrich

OUTPUT_COLUMNS = [S.ID, S.PROB, S.PRED, S.RISK_BAND, S.MONTHLY, S.CONTRACT, S.TENURE, S.INTERNET]


def scored_stream(spark: SparkSession, source_dir: str, schema: StructType, model: M.FittedModel, median: float) -> DataFrame:
    stream = spark.readStream.schema(schema).parquet(source_dir)
    return M.score(model, enrich(stream, median=median)).select(*OUTPUT_COLUMNS)


def start_scoring(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    model: M.FittedModel,
    median: float,
    sink_dir: str,
    checkpoint_location: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the scoring stream into a Parquet sink (exactly-once file sink)."""
    out = scored_stream(spark, source_dir, schema, model, median)
    writer = out.writeStream.format("parquet").option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_dir)
