"""Bundles of many main pages at once, from tables of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import slug_any
from folioforge.operators import assets, extract, outcomes, render
from folioforge.operators.joins import join_popular
from folioforge.operators.names import source_name
from folioforge.sources.captures import classified, pieces
from folioforge.storage import collected, forget, stored

TITLE = "title"


def _entry_title(kind, parsed, subtype, heading, final):
    return F.when(kind == "html", parsed).otherwise(outcomes.reference_title("cls.kind", "cls.subtype", "parsed_title", "markdown_title", final))


def main_pages(mains: DataFrame, seen: DataFrame) -> DataFrame:
    """mains (bundle_id, url) with their classified responses; a main page without one has none of its columns."""
    joined = mains.select("bundle_id", F.col("url").alias("requested_url")).join(seen, "requested_url", "left")
    return joined.withColumn(TITLE, _entry_title(F.col("cls.kind"), F.col("parsed_title"), F.col("cls.subtype"), F.col("markdown_title"), "final_url"))


def main_links(pages: DataFrame) -> DataFrame:
    """Direct references of main pages: bundle_id, pos, main_url, link_url, link_label, source_name; pos counts documents from 0."""
    html = pages.where("cls.kind = 'html'")
    found = extract.links(html, ["bundle_id", "final_url"], "article_html", "final_url")
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy("pos")) - 1
    placed = found.select("bundle_id", place.alias("pos"), F.col("final_url").alias("main_url"), "link_url", "link_label")
    return placed.withColumn("source_name", source_name("pos"))


class Tables(dict[str, DataFrame]):
    """Tables by name, and the stored steps that they read."""

    steps: list[DataFrame]


def release(tables: Tables) -> None:
    forget(*tables.steps)


def bundles(mains: DataFrame, sources: DataFrame, images: DataFrame, chunks: DataFrame | None = None) -> Tables:
    """All tables of the bundles of mains (bundle_id, url).

    sources: responses, one per requested_url. images: image_url, body,
    content_type, fail_reason, one per address. chunks: the pieces (CHUNKS) of
    sources that were assembled() from them; files take their bytes from there, so
    that no body of an asset is ever whole in one row. Returns outcomes, link_map,
    manifest, manifest_files (bundle_id, chunk, text), asset_outcomes, rendered
    (bundle_id, relative_path, markdown) and files (bundle_id, relative_path, chunk, body). They read tables stored in the shared
    folder, which release(tables) deletes once they have been written.
    """
    with collected() as steps:
        made = _bundles(mains, sources, images, chunks)
    made.steps = steps
    return made


def _bundles(mains: DataFrame, sources: DataFrame, images: DataFrame, chunks: DataFrame | None) -> Tables:
    # each is read by several of the tables
    seen = stored(classified(sources))
    pages = stored(main_pages(mains, seen))
    links = stored(main_links(pages))
    told = outcomes.resolve_references(links, seen.select("requested_url", "fetched_url", "final_url", "content_type", "fail_reason", "cls", "parsed_title", "markdown_title", "main_html", "article_html"))
    main_rows = pages.select("bundle_id", F.col("final_url").alias("page_url"), "requested_url", "fetched_url", "final_url", TITLE)
    links_to = outcomes.link_map(main_rows, told)
    sections = outcomes.reference_sections(links, links_to)

    columns = ["bundle_id", "relative_path", "requested_url", "fetched_url", "final_url", "content_type", "title", "cls", "main_html", "article_html", "text_body", "body"]
    first = pages.withColumn("relative_path", F.lit("index.md")).select(*columns)
    readable = told.where("kind in ('readable', 'asset')").select("bundle_id", "relative_path", "title", "asset_path", "link_url")
    others = join_popular(readable, seen.withColumnRenamed("requested_url", "link_url").withColumn("requested_url", F.col("link_url")), "link_url", ["bundle_id", "relative_path"], "inner")
    every = first.withColumn("asset_path", F.when(F.col("cls.kind") == "asset", F.concat(F.lit("assets/source"), F.col("cls.extension")))).unionByName(others.select(*columns, "asset_path"))

    html = every.where("cls.kind = 'html'").withColumn("page_url", F.col("final_url"))
    shown = extract.images(html, ["bundle_id", "relative_path", "final_url"], "article_html", "final_url").withColumnRenamed("relative_path", "page_path")
    kept = assets.outcomes(shown, images)
    parts = ["relative_path", "page_url", "title", "requested_url", "fetched_url", "final_url", "content_type", "main_html"]
    rendered = render.render_html(html.select("bundle_id", *parts), links_to, kept, sections)

    head = render.header("title", "requested_url", "fetched_url", "final_url", "content_type")
    text = every.where("cls.kind = 'text'").select("bundle_id", "relative_path", render.text_entry(head, "text_body", "title", "cls.subtype", "cls.language", "cls.render", slug_any).alias("markdown"))
    asset = every.where("cls.kind = 'asset'").select("bundle_id", "relative_path", render.asset_entry(head, "asset_path", "relative_path").alias("markdown"))
    stubs = told.where("kind = 'failed'").select("bundle_id", "relative_path", render.failure_stub("title", "link_url", "fail_reason").alias("markdown"))
    kept_whole = every.where("cls.kind = 'asset'").withColumnRenamed("asset_path", "file_path")
    if chunks is None:
        files = kept_whole.select("bundle_id", F.col("file_path").alias("relative_path"), F.lit(0).alias("chunk"), "body")
    else:  # an empty body has no pieces, but a file
        files = kept_whole.select("bundle_id", F.col("file_path").alias("relative_path"), "requested_url").join(pieces(chunks), "requested_url", "left").select("bundle_id", "relative_path", F.coalesce("chunk", F.lit(0)).alias("chunk"), "body")
    localized = kept.where("kind = 'localized'").join(images.select("image_url", "body"), "image_url").select("bundle_id", F.col("file_path").alias("relative_path"), F.lit(0).alias("chunk"), "body")
    return Tables({
        "outcomes": told,
        "link_map": links_to,
        "manifest": outcomes.manifests(told, mains),
        "manifest_files": outcomes.manifest_files(told, mains),
        "asset_outcomes": kept,
        "rendered": rendered.unionByName(text).unionByName(asset).unionByName(stubs),
        "files": files.unionByName(localized),
    })
