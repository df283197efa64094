"""Sinks: one dataset per result table, and the text report.

The analysed workflow writes one workbook sheet per result; here every
logical sheet is its own Parquet dataset written by the executors (no
single-machine file format, nothing funnelled through the driver).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


MANIFESTS = "manifests"


def export_results(tables: dict[str, DataFrame], out_dir: str, keep: int = 2) -> DataFrame:
    """Write all tables as one version of the export and return (dataset, rows, path) for every dataset.

    The tables go to a new folder, counted as they are written; a manifest
    with their names, rows and folders is put in place last, in one atomic
    step that fails if another writer took that number (then the next one is
    taken).  Readers follow the newest manifest (``read_export``), so they see
    all tables of one version or none of it: a run that fails or is killed
    leaves the version before it.  The ``keep`` newest versions stay, so that
    readers of the one before can finish; older ones and what failed runs left are deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"version-{uuid.uuid4().hex[:16]}"
    datasets = {}
    for name, df in tables.items():
        seen = Observation(f"rows of {name}")
        path = f"{out_dir}/{version}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        datasets[name] = {"path": f"{version}/{name}", "rows": seen.get["rows"]}
    _commit(spark, out_dir, {"version": version, "datasets": datasets})
    _vacuum(spark, out_dir, keep)
    rows = [(name, d["rows"], f"{out_dir}/{d['path']}") for name, d in datasets.items()]
    return spark.createDataFrame(rows, "dataset string, rows long, path string")


def read_export(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of the newest whole version of an export, by name; empty if there is none."""
    found = _manifests(spark, out_dir)
    if not found:
        return {}
    datasets = _manifest(spark, out_dir, found[-1])["datasets"]
    return {name: spark.read.parquet(f"{out_dir}/{d['path']}") for name, d in datasets.items()}


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system (local, HDFS or an object store, as the path says)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, out_dir: str) -> list[int]:
    """Numbers of the manifests, oldest first."""
    p, fs = _files(spark, f"{out_dir}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, out_dir: str, number: int) -> dict:
    lines = spark.read.text(f"{out_dir}/{MANIFESTS}/{number:012d}.json").collect()  # one line per version
    return json.loads(lines[0][0])


def _commit(spark: SparkSession, out_dir: str, manifest: dict) -> None:
    """Write the manifest beside its place and rename it there; renaming onto an existing file fails."""
    temporary, fs = _files(spark, f"{out_dir}/{MANIFESTS}/{manifest['version']}.tmp")
    stream = fs.create(temporary, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    number = max([0, *_manifests(spark, out_dir)]) + 1
    while True:
        place, _ = _files(spark, f"{out_dir}/{MANIFESTS}/{number:012d}.json")
        if not fs.exists(place) and fs.rename(temporary, place):
            return
        number += 1


def _vacuum(spark: SparkSession, out_dir: str, keep: int) -> None:
    """Delete manifests before the ``keep`` newest, and version folders older than the newest kept manifest that none names."""
    numbers = _manifests(spark, out_dir)
    old, kept = numbers[:-keep], numbers[-keep:]
    named = {_manifest(spark, out_dir, n)["version"] for n in kept}
    for n in old:
        p, fs = _files(spark, f"{out_dir}/{MANIFESTS}/{n:012d}.json")
        fs.delete(p, False)
    first, fs = _files(spark, f"{out_dir}/{MANIFESTS}/{kept[0]:012d}.json")
    before = fs.getFileStatus(first).getModificationTime()
    top, fs = _files(spark, out_dir)
    for s in fs.listStatus(top):
        name = s.getPath().getName()
        # a folder that is younger may belong to a writer at work
        if name.startswith("version-") and name not in named and s.getModificationTime() < before:
            fs.delete(s.getPath(), True)


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines (section, line_no, text) as one ordered text file.

    The report has a few dozen lines (one block per plan segment plus the
    summary), so a single output file is bounded by construction.
    """
    sections = F.array(*[F.lit(s) for s in ("evaluation", "features", "segments", "retention", "summary")])
    order = F.array_position(sections, F.col("section"))
    lines.orderBy(order, "line_no").select("text").coalesce(1).write.mode("overwrite").text(path)
