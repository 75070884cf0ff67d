"""Images of a page: which to keep, and under what names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.classify import extension_of_type, image_format, image_size, tiny
from folioforge.functions.text import asset_dir, relative_path, slug_any, truncate
from folioforge.functions.urls import extension, stem
from folioforge.operators.extract import first_only

#: Fewer bytes than this are decoration. A fixed value.
LEAST_BYTES = 512


def verdict(body: str = "body", fail_reason: str = "fail_reason") -> Column:
    """failed, not_image, too_small_bytes or tiny_dimensions, the first that holds; null for images to keep."""
    size = image_size(body)
    return (
        F.when(F.col(fail_reason).isNotNull() | F.col(body).isNull(), F.lit("failed"))
        .when(image_format(body).isNull(), F.lit("not_image"))
        .when(F.length(body) < LEAST_BYTES, F.lit("too_small_bytes"))
        .when(tiny(size["width"], size["height"]), F.lit("tiny_dimensions"))
    )


def file_extension(content_type: str, url: str) -> Column:
    return F.coalesce(extension_of_type(content_type), extension(url, 6), F.lit(".bin"))


def outcomes(images: DataFrame, fetched: DataFrame) -> DataFrame:
    """Outcome of each different image of a page.

    images: bundle_id, page_path, pos, image_url, alt. fetched, one row per
    image_url: image_url, body, content_type, fail_reason. An address is
    fetched once however many pages show it. Images that are kept are numbered
    in page order. Returns bundle_id, page_path, pos, image_url, kind
    (localized, dropped or failed), reason, file_path, relative_path.
    """
    page = ["bundle_id", "page_path"]
    once = first_only(images, [*page, "image_url"], ["pos"])
    known = once.join(fetched.select("image_url", "content_type", "fail_reason", verdict().alias("why"), F.lit(True).alias("_answered")), "image_url", "left")
    known = known.withColumn("why", F.when(F.col("_answered").isNull(), F.lit("failed")).otherwise(F.col("why"))).drop("_answered")
    kept = F.col("why").isNull()
    shown = F.when(F.coalesce(F.col("alt"), F.lit("")) == "", stem("image_url")).otherwise(F.col("alt"))
    # all but the number is worked out before the window: behind it, and several times, it would be too much code for one stage
    known = known.withColumns({"_slug": truncate(slug_any(shown, ""), 80), "_ext": file_extension("content_type", "image_url"), "_dir": asset_dir("page_path"), "_near": relative_path("page_path", asset_dir("page_path"))})
    number = F.sum(kept.cast("int")).over(Window.partitionBy(*page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    padded = F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    numbered = known.withColumn("_n", padded).withColumn("_name", F.concat("_n", F.lit("-"), F.when(F.col("_slug") == "", F.concat(F.lit("image-"), "_n")).otherwise(F.col("_slug")), "_ext"))
    path, near = (F.concat(c, F.lit("/"), "_name") for c in ("_dir", "_near"))
    return numbered.select(
        *page, "pos", "image_url",
        F.when(kept, F.lit("localized")).when(F.col("why") == "failed", F.lit("failed")).otherwise(F.lit("dropped")).alias("kind"),
        F.when(F.col("why") != "failed", F.col("why")).alias("reason"), F.when(F.col("why") == "failed", F.coalesce("fail_reason", F.lit("No response"))).alias("fail_reason"),
        F.when(kept, path).alias("file_path"), F.when(kept, near).alias("relative_path"),
    )
