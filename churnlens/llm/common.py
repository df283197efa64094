"""Shared helpers: table reading, tables kept in the shared folder, joins with frequent keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written as Parquet under ``spark.checkpoint.dir`` and read again.

    This cuts lineage: a lost executor costs a re-read of files, not a rerun
    of what made them.  ``drop`` deletes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark)}/churnlens-llm/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001 - read back by drop()
        return out

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` as a table in sorted buckets of ``key``, one a shuffle partition: joins on it move the other side only."""
        self.n += 1
        path, n = f"{self.base}/{self.n}-{name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        known = f"churnlens_{name}_{uuid.uuid4().hex[:12]}"
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(known)
        out = self.spark.table(known)
        out._scratch_path, out._scratch_table = path, known  # noqa: SLF001
        return out

    def drop(self, df: DataFrame) -> None:
        if hasattr(df, "_scratch_table"):
            self.spark.sql(f"DROP TABLE IF EXISTS {df._scratch_table}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(conf).delete(path, True)

    def drop_shuffles(self) -> None:
        """Have the shuffle files of finished plans deleted now: Spark does it once the driver collects their objects."""
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows (a job that stops counting there)."""
    return df.limit(max_rows + 1).count() <= max_rows


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


#: A key is frequent if it has over 1 / HOT of all rows, so there are fewer than HOT frequent keys.
HOT = 4096


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``found`` (one row per key, nulls equal) without one task per frequent key.

    ``count`` names the column of ``found`` with a key's rows, ``total`` is
    the number of all rows.  Frequent keys (fewer than ``HOT``) are broadcast,
    the others are joined by shuffle and are thin.
    """
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    more = [F.col(f"f.{c}") for c in found.columns if c not in keys]
    hot = F.broadcast(found.where(F.col(count) * HOT > total)).alias("f")
    cold = found.where(F.col(count) * HOT <= total).alias("f")
    r = rows.alias("r")
    near = r.join(hot, same("r", "f")).select("r.*", *more)
    rest = r.join(hot, same("r", "f"), "left_anti").alias("r")
    return near.unionByName(rest.join(cold, same("r", "f"), "left").select("r.*", *more))
