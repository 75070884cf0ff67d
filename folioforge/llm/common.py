"""What the corpus operators share: tables on shared storage, Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import ensure_importable, small_batches


def prepare(spark: SparkSession) -> SparkSession:
    """Called by each operator before it plans: small Arrow batches, importable workers."""
    ensure_importable(spark)
    small_batches(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a single-JVM session (tests) may fall back to a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir"):
        return path
    if not (conf.get("spark.master") or "").startswith(("local[", "local")) or "cluster" in conf.get("spark.master"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="folioforge-")
    shared_dir.own = path
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write df to shared storage and read it back: cuts lineage, survives lost executors.

    The driver's garbage collection afterwards lets Spark delete the shuffle
    files of the finished job, so the disk in use is that of one step.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/folioforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._stash = path
    return out


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, once the listeners let go of the last job's plan.

    Each keeps its last event until the next one comes, hence the query that
    runs nothing.
    """
    spark.sql("select 1").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_stash", None):
            jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text, one row at least."""
    array = batch.column(column).cast(pa.binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; a worker that has finished a task gives its free memory back, as it may idle for long."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph of BIGINT nodes.

    edges: columns a, b; null ends and loops count for nothing. Returns node
    and root, one row per node that has an edge; root is the component's least
    node. Parents hook onto smaller grandparents along edges and then point to
    their grandparents, so long chains take logarithmically many rounds. Every
    round works on tables in shared storage, and the joins on a popular parent
    stand directly on plain exchanges, where adaptive execution can split them.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = stash(both.select("a", "b").union(both.select("b", "a")).distinct())
    parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("f"))
    before, old = None, []
    while True:
        parents = stash(parents)
        up = parents.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        tree = stash(parents.join(up, "f").select("node", "f", "gf"))
        now = tree.agg(F.sum(F.col("gf").cast("decimal(38,0)")), F.sum(F.col("f").cast("decimal(38,0)"))).first()
        if now == before or now[0] is None:
            unstash(both, parents, *old)
            return tree.select("node", F.col("gf").alias("root"))
        before = now
        unstash(*old)
        near = both.join(tree.select(F.col("node").alias("b"), "gf"), "b").groupBy(F.col("a").alias("node")).agg(F.min("gf").alias("m"))
        moved = tree.join(near, "node").select(
            F.explode(F.array(F.struct(F.col("f").alias("node"), F.col("m").alias("f")), F.struct("node", F.least("m", "gf", "f").alias("f")))).alias("x")
        )
        old = [parents, tree]
        parents = moved.groupBy(F.col("x.node").alias("node")).agg(F.min("x.f").alias("f"))
