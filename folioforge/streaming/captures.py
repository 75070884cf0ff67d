"""Captures that keep arriving: stateless parsing, first-seen documents, bundles batch by batch."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.functions.urls import document_key
from folioforge.plans.bundle import bundles
from folioforge.sources.captures import SOURCES, classified
from folioforge.storage import collected, forget, stored
from folioforge.streaming.keyed import SALTS, touched


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16, schema: str = SOURCES + ", ingested timestamp") -> DataFrame:
    """Captures as they land in a folder of Parquet files, with the time they were taken in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each document once, as long as its repeats come within the watermark: state is bounded by it."""
    keyed = stream.withColumn("doc_key", document_key("final_url")).withWatermark("ingested", within)
    return keyed.dropDuplicatesWithinWatermark(["doc_key"])


def parsed(stream: DataFrame) -> DataFrame:
    """Class, title and content of each capture; no state."""
    return classified(stream).select("ingested", "final_url", F.col("cls.kind").alias("kind"), F.col("parsed_title").alias("title"), "main_html", "article_html")


def located(stream: DataFrame) -> DataFrame:
    """The stream with the file of each row, which read_stream() and other streams of files can tell."""
    return stream if "file" in stream.columns else stream.select("*", F.col("_metadata.file_path").alias("file"))


def answers(spark: SparkSession, touched: DataFrame, schema: StructType) -> DataFrame:
    """The responses (SOURCES) that touched bundles have, one per address, read from the files that hold them and from no other."""
    files = [unquote(r.file) for r in touched.select("file").distinct().toLocalIterator()]  # as many as the read lists anyway
    names = [c.split()[0] for c in SOURCES.split(", ")]
    wanted = touched.select(F.col("address").alias("requested_url"), "file", "taken", "good").distinct()
    held = spark.read.schema(schema).parquet(*files).select(*names, F.coalesce(F.unix_micros("ingested"), F.lit(0)).alias("taken"), F.col("_metadata.file_path").alias("file"))
    found = held.withColumn("good", F.col("fail_reason").isNull()).join(wanted, ["requested_url", "file", "taken", "good"], "left_semi")
    # of rows that differ in nothing that ranks them, any, but always the same
    rest = [n for n in names if n != "requested_url"]
    return found.groupBy("requested_url").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("s")).select("requested_url", "s.*").select(*names)


def write_bundles(stream: DataFrame, path: str, checkpoint: str, images: DataFrame, salts: int = SALTS):
    """Start a query that bundles main pages as they arrive, and anew those whose references get a new or better answer.

    stream: captures from files (SOURCES, role, bundle_id, ingested). Rows with
    role main name the pages to bundle, of several for one bundle the last; all
    rows answer their address. Of several answers a good one counts before a
    failure and a later one before an earlier one, in whatever order and batches
    they arrive, so newest() gives the tables that one batch with all rows
    would. A later capture of a main page changes what its bundle asks for if it
    has that role too. State holds addresses and the names of files, which must
    stay; a batch reads its own rows and the files of the bundles that it makes.
    A batch that is repeated writes the same places.
    """
    spark = stream.sparkSession
    schema = StructType([f for f in stream.schema if f.name != "file"])
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def one(batch: DataFrame, batch_id: int) -> None:
        with collected() as steps:
            rows = stored(batch)
            if rows.head(1):
                mains = rows.where("address = main_url").select("bundle_id", F.col("main_url").alias("url"))
                tables = bundles(mains, answers(spark, rows, schema), images)
                for name, df in [*tables.items(), (MADE, mains.select("bundle_id"))]:
                    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        forget(*steps)

    had = spark.conf.get(provider)
    spark.conf.set(provider, rocks)  # the state of this query alone: its session keeps a copy
    try:
        return touched(located(stream), salts).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set(provider, had)


#: The bundles of each batch; written last, so a batch without it is not complete.
MADE = "made"


def newest(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a table of write_bundles() as the last batch that made each bundle left them."""
    last = spark.read.parquet(f"{path}/{MADE}").groupBy("bundle_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/{table}").join(last, ["bundle_id", "batch"], "left_semi").drop("batch")
