"""Names of references within a bundle: in link order, the first free of base, base-2, base-3 and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import slug_any
from folioforge.storage import forget, stored

_BASE = ["bundle_id", "base"]


def source_name(pos) -> Column:
    """The name under which the response to a bundle's link is kept, by its place, counted from 1, skipped links included."""
    place = (F.col(pos) if isinstance(pos, str) else pos) + 1
    digits = place.cast("string")
    return F.concat(F.lit("reference-"), F.when(place < 1000, F.lpad(digits, 3, "0")).otherwise(digits), F.lit(".source"))


def contests(named: DataFrame) -> DataFrame:
    """Names that two bases may claim: bundle_id, base, k, child, before.

    Only base with its number k and the base that is spelled so, the child, can
    want one name. The child's first reference wants it as soon as it comes; by
    then ``before`` references of base have come.
    """
    bases = named.groupBy(*_BASE).agg(F.min("pos").alias("pos"))
    pattern = r"(?s)\A(.+)-([2-9]|[1-9][0-9]{1,14})\z"
    children = bases.select("bundle_id", F.regexp_extract("base", pattern, 1).alias("parent"), F.regexp_extract("base", pattern, 2).alias("k"), F.col("base").alias("child"), "pos")
    children = children.where("parent <> ''").withColumn("k", F.col("k").cast("long")).withColumnRenamed("parent", "base")
    children = children.join(bases.select(*_BASE), _BASE, "left_semi")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("k", "long"), ("child", "string"))]
    events = named.join(children.select(*_BASE).distinct(), _BASE, "left_semi").select(*_BASE, *none, "pos").unionByName(children)
    so_far = Window.partitionBy(*_BASE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("before", F.sum(F.col("child").isNull().cast("long")).over(so_far)).where("child is not null").select(*_BASE, "k", "child", "before")


def settled(contested: DataFrame) -> DataFrame:
    """contested with taken: whether the child gets the name, as base comes to its number k only later or never.

    Base comes to k with its (own + k - 1 - lost)-th reference, where own is 1 if
    its first one got the plain name and lost counts its smaller numbers that
    others got. Both hang on other contests alone, nearer to the root or of a
    smaller number, so repeating the step settles one more each time at least;
    in practice two or three steps settle all.
    """
    now = stored(contested.withColumn("taken", F.lit(True)))
    smaller = Window.partitionBy(*_BASE).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        own = now.select("bundle_id", F.col("child").alias("base"), F.col("taken").cast("long").alias("own"))
        lost = F.coalesce(F.sum(F.col("taken").cast("long")).over(smaller), F.lit(0))
        told = now.withColumn("lost", lost).join(own, _BASE, "left")
        new = stored(told.select(*_BASE, "k", "child", "before", F.col("taken").alias("was"), (F.coalesce("own", F.lit(1)) + F.col("k") - 1 - F.col("lost") > F.col("before")).alias("taken")))
        forget(now)
        now = new
        if not new.where("was <> taken").head(1):
            return now


def allocate_names(outcomes: DataFrame) -> DataFrame:
    """bundle_id, pos and relative_path of outcomes (bundle_id, pos, title) that use a name.

    A name is base with the count of its references so far, unless another
    base is spelled like that. Such contests are settled among themselves, by
    joins and windows; a bundle of any size is spread over tasks by its bases.
    """
    named = stored(outcomes.select("bundle_id", "pos", slug_any("title", "reference").alias("base")))
    turn = named.withColumn("n", F.row_number().over(Window.partitionBy(*_BASE).orderBy("pos")).cast("long"))
    contested = stored(contests(named))
    if not contested.head(1):
        number = turn
    else:
        done = settled(contested)
        own = done.select("bundle_id", F.col("child").alias("base"), F.col("taken").cast("long").alias("own"))
        # the t-th number that base gives is t + 1, and one more for each taken one that comes before it
        rows = turn.join(own, _BASE, "left").select(*_BASE, "pos", (F.col("n") - F.coalesce("own", F.lit(1))).alias("t"), F.lit(0).alias("gone"))
        smaller = Window.partitionBy(*_BASE).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        gaps = done.where("taken").withColumn("lost", F.coalesce(F.count("*").over(smaller), F.lit(0)))
        gaps = gaps.select(*_BASE, F.lit(None).cast("int").alias("pos"), (F.col("k") - 1 - F.col("lost")).alias("t"), F.lit(1).alias("gone"))
        before = Window.partitionBy(*_BASE).orderBy("t", F.desc("gone")).rowsBetween(Window.unboundedPreceding, 0)
        every = rows.unionByName(gaps.withColumn("pos", F.col("pos").cast(rows.schema["pos"].dataType)))
        number = every.withColumn("skipped", F.sum("gone").over(before)).where("gone = 0").select(*_BASE, "pos", F.when(F.col("t") == 0, 1).otherwise(F.col("t") + 1 + F.col("skipped")).alias("n"))
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit(""))
    return number.select("bundle_id", "pos", F.concat(F.lit("references/"), "base", suffix, F.lit(".md")).alias("relative_path"))
