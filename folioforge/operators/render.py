"""Markdown for each page of a bundle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions import web
from folioforge.functions.arrow import python_udf
from folioforge.functions.text import closing_newline, col, fence, relative_path, slug_any, tidy_converted, tidy_markdown
from folioforge.operators.extract import clean, without_first_h1
from folioforge.operators.markdown import convert

# The sentences of stubs.
FAILED = "Failed to download this source."
DEFERRED = "Text extraction is deferred to a specialized pipeline."

_CHROME = frozenset({"logo", "icon", "avatar", "pixel", "spacer", "badge"})


def header(title, requested, fetched, final, content_type) -> Column:
    """Title and provenance; addresses that say nothing new are left out."""
    t, r, f, e, c = map(col, (title, requested, fetched, final, content_type))
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    return F.concat_ws("\n", F.concat(F.lit("# "), t), F.lit(""), line("Source", r), F.when(f != r, line("Fetched URL", f)), F.when(e != f, line("Final URL", e)), F.when(c != "", line("Content-Type", c)))


def failure_stub(title, url, reason) -> Column:
    return F.concat(F.lit("# "), col(title), F.lit("\n\nSource: "), col(url), F.lit(f"\n\n{FAILED}\n\nReason: "), col(reason), F.lit("\n"))


def asset_entry(head, asset_path, markdown_path) -> Column:
    local = relative_path(markdown_path, asset_path)
    return F.concat(col(head), F.lit("\n\nOriginal source asset: ["), local, F.lit("]("), local, F.lit(f")\n\n{DEFERRED}\n"))


def text_entry(head, body, title, subtype, language, render, make=slug_any) -> Column:
    """Markdown is tidied, plain text stays, anything else is fenced."""
    b = col(body)
    direct = closing_newline(F.when(col(subtype) == "markdown", tidy_markdown(b, title, make)).otherwise(b))
    marks = fence(b)
    named = F.when(F.coalesce(col(language), F.lit("")) == "", F.lit("text")).otherwise(col(language))
    fenced = F.concat(marks, named, F.lit("\n"), closing_newline(b), marks, F.lit("\n"))
    return F.concat(col(head), F.lit("\n\n"), F.when(col(render) == "direct", direct).otherwise(fenced))


def localized_anchors(html: str, base: str, targets: dict[str, str]) -> str:
    def one(m: re.Match) -> str:
        url = web.normalize(base, m[2])
        if not url:
            return m[0]
        local = targets.get(url) or targets.get(url.split("#")[0])
        if not local and re.match(r"(?i)#|mailto:|tel:|javascript:", m[2]):
            return m[0]
        return f"{m[1]}{local or url}{m[3]}"

    return re.sub(r'(?i)(<a\b[^>]*href=")([^"]+)("[^>]*>)', one, html)


def _decorates(name: str) -> bool:
    return bool(_CHROME & set(name.split("-")))


def decoration(url: str, alt: str) -> bool:
    if _decorates(web.slug(alt, "")):
        return True
    path = re.match(r"[a-z][a-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", url)
    name = path[1].rstrip("/").rsplit("/", 1)[-1] if path else ""
    return _decorates(web.slug(re.sub(r"(?<=.)\.[^.]*\Z", "", name), ""))


def localized_images(html: str, base: str, kept: dict[str, str | None]) -> str:
    """Paths for kept images; those dropped (None) and decoration go, others become absolute."""

    def one(m: re.Match) -> str:
        url = web.asset_address(base, m[2])
        if not url:
            return m[0]
        alt = re.search(r'(?i)\balt="([^"]*)"', m[0])
        if decoration(url, (web.decode_entities(alt[1]) or "") if alt else ""):
            return ""
        if url in kept:
            return "" if kept[url] is None else f"{m[1]}{kept[url]}{m[3]}"
        return f"{m[1]}{url}{m[3]}"

    return re.sub(r'(?i)(<img\b[^>]*src=")([^"]+)("[^>]*>)', one, html)


@python_udf(StringType())
def localize(html: pd.Series, base: pd.Series, targets: pd.Series, kept: pd.Series) -> pd.Series:
    """Anchors and images of a fragment; targets and kept are lists of (key, path)."""
    return pd.Series(
        [None if h is None else localized_images(localized_anchors(h, b, _pairs(t)), b, _pairs(k)) for h, b, t, k in zip(html, base, targets, kept)], dtype=object
    )


def _pairs(rows) -> dict:
    return {} if rows is None else {r["key"]: r["path"] for r in rows}


@python_udf(StringType())
def to_markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in batches:
        yield pd.Series([None if h is None else convert(h) for h in html], dtype=object)


def html_body(html, self_name=None) -> Column:
    """Markdown of a fragment whose links and images are local already."""
    return tidy_converted(to_markdown(without_first_h1(html)), self_name)


def _paths(local: DataFrame, keys: list[str], name: str) -> DataFrame:
    return local.groupBy(*keys).agg(F.collect_list(F.struct("key", "path")).alias(name))


def render_html(pages: DataFrame, links_to: DataFrame, image_outcomes: DataFrame, sections: DataFrame) -> DataFrame:
    """bundle_id, relative_path and markdown of HTML pages.

    pages: bundle_id, relative_path, page_url, title, requested_url,
    fetched_url, final_url, content_type, main_html. A page receives only the
    addresses that its own anchors use, not its bundle's whole map.
    """
    from folioforge.operators.extract import raw_links
    from folioforge.functions.urls import document_key, resolve

    keys = ["bundle_id", "relative_path"]
    used = pages.select(*keys, "page_url", F.explode(raw_links("main_html")).alias("a")).select(*keys, resolve("page_url", "a.href").alias("url")).where("url is not null").distinct()
    wanted = used.select(*keys, F.explode(F.array_distinct(F.array("url", document_key("url")))).alias("key")).distinct()
    hits = wanted.join(links_to.select("bundle_id", "key", F.col("relative_path").alias("target")), ["bundle_id", "key"])
    targets = _paths(hits.select(*keys, "key", relative_path("relative_path", "target").alias("path")), keys, "targets")
    shown = image_outcomes.where("kind <> 'failed'").select("bundle_id", F.col("page_path").alias("page"), F.col("image_url").alias("key"), F.col("relative_path").alias("path"))
    kept = _paths(shown.withColumnRenamed("page", "relative_path_").select("bundle_id", F.col("relative_path_"), "key", "path"), ["bundle_id", "relative_path_"], "kept").withColumnRenamed("relative_path_", "relative_path")
    full = pages.join(targets, keys, "left").join(kept, keys, "left").join(sections, "bundle_id", "left")
    body = html_body(localize(clean("main_html"), "page_url", "targets", "kept"), F.regexp_extract("relative_path", r"([^/]*)\z", 1))
    head = header("title", "requested_url", "fetched_url", "final_url", "content_type")
    head = F.concat_ws("\n\n", head, F.when(F.col("relative_path") == "index.md", F.col("section")))
    return full.select(*keys, F.concat(head, F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))
