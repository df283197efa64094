"""Subscriber sources.

``subscriber_view`` derives one subscriber row per ``customer`` from the
driver tables (tenure from the customer's last fulfilled order; the other
attributes from key arithmetic, see FIXTURES.md).  ``read_subscribers_csv``
reads the public telco CSV layout with an explicit schema.  Both return the
same internal column names, so every operator works on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens import schema as S


#: columns of ``subscriber_view`` that a real subscriber table does not have
FIXTURE_COLUMNS = ("k", "score")


def _svc(k: Column, internet: Column, mod: int, below: int) -> Column:
    return (
        F.when(internet == "No", F.lit(S.NO_INTERNET))
        .when(k % mod < below, F.lit(S.YES))
        .otherwise(F.lit(S.NO))
    )


def subscriber_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the subscriber columns of the analysed workflow.

    Plan: ``orders`` is filtered (pushed to the scan) and pre-aggregated per
    customer (partial + final hash aggregate, so a customer holding a third
    of all orders still sends one row per map task), then left-joined to
    ``customer`` on the key.  The aggregate already hash-partitions by the
    key, so only ``customer`` is shuffled for the join; AQE may turn it into
    a broadcast when the runtime size allows.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")

    last = (
        orders.where(F.col("o_orderstatus") == "F")
        .groupBy("o_custkey")
        .agg(F.max("o_orderdate").alias("last_d"))
    )
    base = customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").join(
        last, F.col("c_custkey") == F.col("o_custkey"), "left"
    )

    k = F.col("c_custkey")
    last_d = F.col("last_d")
    tenure = F.coalesce((2001 - F.year(last_d)) * 12 + 8 - F.month(last_d), F.lit(0)).cast("int")
    contract = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("One year"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("Two year"))
        .otherwise(F.lit(S.MONTH_TO_MONTH))
    )
    nat = F.col("c_nationkey") % 3
    internet = F.when(nat == 0, F.lit("DSL")).when(nat == 1, F.lit(S.FIBER)).otherwise(F.lit("No"))
    monthly = F.lit(18.25) + ((k * 37) % 401) * F.lit(0.25)

    b = base.select(
        k.alias("k"),
        F.col("c_name").alias(S.ID),
        tenure.alias(S.TENURE),
        contract.alias(S.CONTRACT),
        internet.alias(S.INTERNET),
        monthly.alias(S.MONTHLY),
    )

    k = F.col("k")
    t = F.col(S.TENURE)
    m = F.col(S.MONTHLY)
    net = F.col(S.INTERNET)
    c = F.col(S.CONTRACT)
    total_raw = (
        F.when(t == 0, F.lit(" "))
        .when(k % 211 == 5, F.lit("0"))
        .otherwise((t * m).cast("string"))
    )
    backup = F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(_svc(k, net, 3, 1))
    mtm = F.when(c == S.MONTH_TO_MONTH, 1).otherwise(0)
    short = F.when(t < 12, 1).otherwise(0)
    fiber = F.when(net == S.FIBER, 1).otherwise(0)
    churn = F.when((k * 61) % 100 < 10 + 30 * mtm + 15 * short + 10 * fiber, F.lit(S.YES)).otherwise(F.lit(S.NO))
    score = (8 + 40 * mtm + 24 * short + 16 * fiber + (k * 29) % 41) / F.lit(128.0)

    return b.select(
        "k",
        S.ID,
        S.TENURE,
        S.CONTRACT,
        S.INTERNET,
        S.MONTHLY,
        total_raw.alias(S.TOTAL_RAW),
        F.when(net == "No", F.lit(S.NO_INTERNET))
        .when(k % 2 == 0, F.lit(S.YES))
        .otherwise(F.lit(S.NO))
        .alias("online_security"),
        backup.alias("online_backup"),
        _svc(k, net, 5, 2).alias("device_protection"),
        _svc(k, net, 7, 3).alias("tech_support"),
        _svc(k, net, 11, 5).alias("streaming_tv"),
        _svc(k, net, 13, 6).alias("streaming_movies"),
        churn.alias(S.CHURN),
        score.alias("score"),
    )


CORRUPT = "corrupt_record"
#: What ``split_subscribers_csv`` writes (given when reading: a folder without rows has no schema of its own).
SPLIT_SCHEMA = T.StructType(
    [*(T.StructField(dst, typ) for _, dst, typ in S.CSV_COLUMNS), *(T.StructField(c, T.StringType()) for c in (CORRUPT, "reason", "file", "kind"))]
)


def read_subscribers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the telco CSV layout with a fixed schema (no inference pass).

    ``PERMISSIVE`` keeps malformed rows, with nulls for what does not parse
    (``split_subscribers_csv`` sets them apart); TotalCharges stays text and
    is parsed leniently by the cleaning step.
    """
    df = (
        spark.read.schema(S.CSV_SCHEMA)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return df.select([F.col(src).alias(dst) for src, dst, _ in S.CSV_COLUMNS])


def split_subscribers_csv(spark: SparkSession, path: str, out_dir: str, header: bool = True) -> DataFrame:
    """Read the CSV layout once and write ``out_dir/rows`` and ``out_dir/quarantine``; returns (kind, n_rows).

    A line whose number of fields differs from the layout, or with a value
    that its column's type does not take, goes whole and unchanged to the
    quarantine, with the reason (``fields`` or ``value``) and the file it came
    from; no value of it reaches ``rows``.  Both sides are written from one
    scan as two folders of one dataset, so the counts add up to the lines read.
    Missing values (empty fields) are no fault, an empty line is no row.
    """
    schema = T.StructType([*S.CSV_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    # every column is parsed, so a fault in any of them is seen whatever the caller selects
    raw = (
        spark.read.schema(schema)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    bad = F.col(CORRUPT).isNotNull()
    # commas outside quotes
    fields = F.size(F.split(CORRUPT, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    reason = F.when(bad, F.when(fields != len(S.CSV_COLUMNS), F.lit("fields")).otherwise(F.lit("value")))
    good = [F.when(~bad, F.col(src)).alias(dst) for src, dst, _ in S.CSV_COLUMNS]
    sides = raw.select(
        *good, CORRUPT, reason.alias("reason"), F.when(bad, F.input_file_name()).alias("file"), F.when(bad, F.lit("quarantine")).otherwise(F.lit("rows")).alias("kind")
    )
    sides.write.mode("overwrite").partitionBy("kind").parquet(out_dir)
    return (
        spark.read.schema(SPLIT_SCHEMA)
        .parquet(out_dir)
        .groupBy(F.when(F.col("reason").isNull(), F.lit("rows")).otherwise(F.concat(F.lit("quarantine: "), F.col("reason"))).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def csv_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows that ``split_subscribers_csv`` took."""
    return spark.read.schema(SPLIT_SCHEMA).parquet(out_dir).where("kind = 'rows'").select(*[dst for _, dst, _ in S.CSV_COLUMNS])


def csv_quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    """The lines it set apart: (line, reason, file)."""
    return spark.read.schema(SPLIT_SCHEMA).parquet(out_dir).where("kind = 'quarantine'").select(F.col(CORRUPT).alias("line"), "reason", "file")


def csv_lines(subscribers: DataFrame, *carry: str) -> DataFrame:
    """Subscribers as lines of the CSV layout (columns they lack stay empty): ``carry`` columns and the text ``value``."""
    def field(dst: str) -> Column:
        text = F.coalesce(F.col(dst).cast("string"), F.lit("")) if dst in subscribers.columns else F.lit("")
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)

    return subscribers.select(*carry, F.concat_ws(",", *[field(dst) for _, dst, _ in S.CSV_COLUMNS]).alias("value"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Row and column count of a table (``shape``): one aggregate, one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("int").alias("n_columns")
    )
