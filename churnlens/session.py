"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "churnlens") -> SparkSession:
    """Session for tests and the local bench.

    On a cluster the caller's own session is used instead; nothing in the
    library depends on these settings except that AQE is expected on.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # one JVM holds every task in local mode, so waiting for a better
        # locality level only delays the tree learner's many small jobs
        # (measured ~12% of GBT fit time); clusters keep their own setting
        .config("spark.locality.wait", "0s")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The context's own checkpoint directory (used by ``checkpoint()`` and the
    tree learner) is set from it when missing.  The returned path is the
    configured base, not the per-application subfolder Spark creates, so
    stored artefacts (fitted models) are found again by later applications.
    Only when nothing is configured and the master is local (tests) is a
    temporary folder used; on a cluster that is an error rather than a
    machine-local path.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="churnlens-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"churnlens-{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names (errors other than absence are raised)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python code in tasks imports ``churnlens``; a cluster whose workers do
    not have it installed gets it as a zip through ``addPyFile``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    if root.suffix != ".zip" and root.is_dir():
        target = os.path.join(tempfile.mkdtemp(prefix="churnlens-code-"), "churnlens_code.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"churnlens/{p.relative_to(root)}")
        sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
