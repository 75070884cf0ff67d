"""Joins on keys of which a few hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is split so that none of its parts holds more than this share of a task's mean rows.
SHARE = 16


def join_popular(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "left", partitions: int | None = None) -> DataFrame:
    """left.join(right, key, how) for a left side of which a few keys may hold most rows; how: left or inner.

    Keys are counted first, so left should be a stored table. A key with more
    than a SHARE-th of what a task would hold on the average is split by a hash
    of the columns in ``spread``, and its rows on the right are copied to each
    part. At most SHARE * partitions keys can be that frequent, so they are sent
    to all tasks. Null keys meet nothing and are spread as well.
    """
    if how not in ("left", "inner"):
        raise ValueError("left or inner")
    spark = left.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, left.count() // (SHARE * partitions))
    often = F.broadcast(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    # a null key gets parts as well, which the right side does not have
    parts = F.when(F.col(key).isNull(), F.lit(SHARE * partitions)).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = left.join(often, key, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copied = right.join(often, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")
