"""Tables of captured responses, and their columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioforge.functions.arrow import python_udf
from folioforge.functions.classify import classify
from folioforge.functions.text import markdown_title
from folioforge.functions.urls import canonical, document_key, upgraded
from folioforge.operators.extract import parse

#: One row per response.
SOURCES = "requested_url string, fetched_url string, final_url string, status int, content_type string, body binary, fetch_method string, fail_reason string"

#: One row per piece of a body, and one at its end, without a body, that tells how the response went. Of several attempts the last counts.
CHUNKS = (
    "requested_url string, fetched_url string, attempt int, chunk int, body binary, last boolean, "
    "final_url string, status int, content_type string, fetch_method string, fail_reason string"
)


def assembled(chunks: DataFrame, every: bool = False) -> DataFrame:
    """Responses (SOURCES, and head: the first piece) from their pieces (CHUNKS).

    body is put together only where something reads it whole, that is for HTML
    and text, or for all with ``every``; that of other classes is null, and
    pieces() has it. A failed response has no body, an empty one an empty body.
    """
    told = chunks.where("last").select("requested_url", "fetched_url", "final_url", "status", "content_type", "fetch_method", "fail_reason", "attempt")
    told = told.withColumn("_n", F.row_number().over(Window.partitionBy("requested_url").orderBy(F.desc("attempt")))).where("_n = 1").drop("_n")
    data = chunks.where("not last").select("requested_url", "attempt", "chunk", "body")
    good = told.where("fail_reason is null")
    first = data.where("chunk = 0").select("requested_url", "attempt", F.col("body").alias("head"))
    known = told.join(first, ["requested_url", "attempt"], "left").withColumn("head", F.when(F.col("fail_reason").isNull(), F.coalesce("head", F.lit(b""))))
    wanted = good if every else known.where("fail_reason is null").where(classify("content_type", "final_url", "head")["kind"] != "asset")
    rows = data.join(wanted.select("requested_url", "attempt"), ["requested_url", "attempt"], "left_semi")
    # a body of one piece, as nearly all are, is not sorted or joined
    parts = rows.groupBy("requested_url", "attempt").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "body"))), lambda x: x["body"]).alias("parts"))
    whole = parts.select("requested_url", "attempt", F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(put_together("parts")).alias("body"))
    kept = known if every else known.withColumn("_text", classify("content_type", "final_url", "head")["kind"] != "asset")
    empty = F.col("fail_reason").isNull() & (F.lit(True) if every else F.col("_text"))
    done = kept.join(whole, ["requested_url", "attempt"], "left").withColumn("body", F.when(empty, F.coalesce("body", F.lit(b""))))
    return done.select(*[c.split()[0] for c in SOURCES.split(", ")], "head")


@python_udf(BinaryType())
def put_together(parts: pd.Series) -> pd.Series:
    return parts.map(lambda own: b"".join(own))


def pieces(chunks: DataFrame) -> DataFrame:
    """requested_url, chunk and body of the pieces that count: those of the last attempt, if it did not fail."""
    told = chunks.where("last").groupBy("requested_url").agg(F.max_by(F.struct("attempt", "fail_reason"), "attempt").alias("t"))
    good = told.where("t.fail_reason is null").select("requested_url", F.col("t.attempt").alias("attempt"))
    return chunks.where("not last").join(good, ["requested_url", "attempt"], "left_semi").select("requested_url", "chunk", "body")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Responses stored as Parquet in the form of SOURCES."""
    return spark.read.schema(SOURCES).parquet(path)


def pages_as_sources(pages: DataFrame) -> DataFrame:
    """Pages (url, html and any others) as responses that were fetched over https with status 200."""
    c = pages.withColumn("requested_url", canonical("url"))
    return c.select(
        *[x for x in pages.columns if x not in ("url", "html")], "requested_url", upgraded("requested_url").alias("fetched_url"), document_key(upgraded("requested_url")).alias("final_url"),
        F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").cast("binary").alias("body"), F.lit("capture").alias("fetch_method"), F.lit(None).cast("string").alias("fail_reason"),
    )


def files_as_sources(spark: SparkSession, path: str, url_prefix: str) -> DataFrame:
    """Files below a folder as responses without a content type: their names and bytes tell what they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    url = F.concat(F.lit(url_prefix), F.regexp_extract("path", r"([^/]*)\z", 1))
    return files.select(
        url.alias("requested_url"), url.alias("fetched_url"), url.alias("final_url"), F.lit(200).alias("status"), F.lit("").alias("content_type"), F.col("content").alias("body"),
        F.lit("file").alias("fetch_method"), F.lit(None).cast("string").alias("fail_reason"),
    )


def classified(sources: DataFrame) -> DataFrame:
    """Add cls, and what the reference plan needs of each class: parsed columns of HTML, the heading of Markdown."""
    sample = F.coalesce("head", "body") if "head" in sources.columns else F.col("body")
    c = sources.withColumn("cls", F.when(F.col("fail_reason").isNull(), classify("content_type", "final_url", sample)))
    text = F.col("body").cast("string")
    c = c.withColumn("html", F.when(F.col("cls.kind") == "html", text)).withColumn("text_body", F.when(F.col("cls.kind") == "text", text))
    return parse(c, "html", "final_url").withColumn("parsed_title", F.when(F.col("html").isNotNull(), F.col("title"))).drop("title").withColumn("markdown_title", markdown_title("text_body"))
