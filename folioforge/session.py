"""Session set-up shared by the command line, the bench and the tests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows in one Arrow batch sent to Python, and bytes after which it ends earlier: whole texts can be long, so few.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "folioforge") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it.

    Workers get the driver's ``SparkContext.environment``; on a cluster whose
    nodes don't share the path, ship the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to BATCH_ROWS and BATCH_BYTES; lower ones stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
