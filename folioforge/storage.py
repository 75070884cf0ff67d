"""Steps written to shared storage, so that what several tables derive from is computed once."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a session in one process may do without."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir"):
        return path
    master = conf.get("spark.master") or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (path := getattr(shared_folder, "own", None)):
        path = shared_folder.own = tempfile.mkdtemp(prefix="folioforge-")
    return path


_open: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("open", default=())


@contextlib.contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The steps that are stored within, for forget()."""
    steps: list[DataFrame] = []
    token = _open.set((*_open.get(), steps))
    try:
        yield steps
    finally:
        _open.reset(token)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: its lineage ends here, and lost executors cost no recomputation.

    All steps of an application lie below one folder of its own, which can go
    when the application has ended.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/bundles-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored = path
    for steps in _open.get():
        steps.append(out)
    return out


def forget(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; others are left alone."""
    for df in frames:
        if path := getattr(df, "_stored", None):
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
