"""Projections of HTML pages: title, content, links and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import col, decode_html, slug_any, strip_tags, trim_start
from folioforge.functions.urls import chrome_name, document_key, is_url, resolve, resolve_asset, stem
from folioforge.operators.chrome import with_cleaned

_META = r'(?is)<meta[^>]+{name}[^>]+content="([^"]+)"'


def _inside(html: Column, tag: str) -> tuple[Column, Column]:
    """Whether the element is there, and what its first one holds up to the next closing tag."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return html.rlike(pattern), F.regexp_extract(html, pattern, 1)


def title(html) -> Column:
    """og:title, twitter:title, the first h1, title; the first of these that counts."""
    h = col(html)
    og, twitter = (strip_tags(F.regexp_extract(h, _META.format(name=n), 1)) for n in ('property="og:title"', 'name="twitter:title"'))
    h1, named = F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?is)<title[^>]*>(.*?)</title>"
    return (
        F.when(og != "", og).when(twitter != "", twitter).when(h1 != "", strip_tags(h1)).when(h.rlike(named), F.trim(strip_tags(F.regexp_extract(h, named, 1)))).otherwise(F.lit("Untitled"))
    )


def main(html) -> Column:
    h = col(html)
    (has_main, in_main), (has_body, in_body) = _inside(h, "main"), _inside(h, "body")
    return F.when(has_main, in_main).when(has_body, in_body).otherwise(h)


def article(html) -> Column:
    has, inside = _inside(col(html), "article")
    return F.when(has, inside).otherwise(col(html))


def clean(html) -> Column:
    """Without scripts, styles, drawings, asides, and class and style attributes."""
    out = col(html)
    for tag in ("script", "style", "noscript", "svg", "aside"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(out, r'(?i)\sclass="[^"]*"', ""), r'(?i)\sstyle="[^"]*"', "")


def without_first_h1(html) -> Column:
    """The first h1 goes, wherever it stands, and with it leading space."""
    h, pattern = col(html), r"(?is)\A(.*?)<h1[^>]*>.*?</h1>"
    return F.when(h.rlike(pattern), trim_start(F.regexp_replace(h, pattern, "$1"))).otherwise(h)


def raw_links(html) -> Column:
    """Array of href and inner HTML of each anchor with a double-quoted href, the tag's last one."""
    pattern = r'(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all(col(html), F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(col(html), F.lit(pattern), F.lit(2)).alias("inner"))
    return both


def raw_images(html) -> Column:
    """Array of src and whole tag of each image with a double-quoted src."""
    pattern = r'(?i)(<img\b[^>]*src="([^"]+)"[^>]*>)'
    return F.arrays_zip(F.regexp_extract_all(col(html), F.lit(pattern), F.lit(2)).alias("src"), F.regexp_extract_all(col(html), F.lit(pattern), F.lit(1)).alias("tag"))


def link_label(inner, make=slug_any) -> Column:
    """What a link says; null if nothing, or if it names decoration."""
    text = strip_tags(inner)
    return F.when((text != "") & ~F.coalesce(chrome_name(make(text, "")), F.lit(False)), text)


def links(pages: DataFrame, keys: list[str], html: str = "html", base: str = "url", make=slug_any) -> DataFrame:
    """Links of each page, one row per document they lead to: keys, pos, link_url, link_label, doc_key.

    pos is the place of the first anchor among all anchors; the first address
    stays with its fragment, and the first label that says something counts.
    """
    every = pages.select(*keys, F.col(base).alias("_base"), F.posexplode(raw_links(html)).alias("pos", "a"))
    every = every.select(*keys, "pos", resolve("_base", "a.href").alias("link_url"), link_label("a.inner", make).alias("link_label")).where("link_url is not null")
    every = every.withColumn("doc_key", document_key("link_url"))
    return every.groupBy(*keys, "doc_key").agg(
        F.min_by("link_url", "pos").alias("link_url"), F.min_by("link_label", F.when(F.col("link_label").isNotNull(), F.col("pos"))).alias("link_label"), F.min("pos").alias("pos")
    ).select(*keys, "pos", "link_url", "link_label", "doc_key")


def image_alt(tag) -> Column:
    return decode_html(F.regexp_extract(col(tag), r'(?i)\balt="([^"]*)"', 1))


def images(pages: DataFrame, keys: list[str], html: str = "html", base: str = "url") -> DataFrame:
    """Images of each page that may be content: keys, pos, image_url, alt. Repeats stay."""
    every = pages.select(*keys, F.col(base).alias("_base"), F.posexplode(raw_images(html)).alias("pos", "i"))
    every = every.select(*keys, "pos", resolve_asset("_base", "i.src").alias("image_url"), image_alt("i.tag").alias("alt")).where("image_url is not null")
    return every.where(~F.coalesce(is_decoration("image_url", "alt"), F.lit(False)) & ~F.startswith(slug_any("alt", ""), F.lit("displaystyle")) & ~F.contains("image_url", F.lit("/math/")))


def is_decoration(url, alt) -> Column:
    return chrome_name(slug_any(alt, "")) | (is_url(url) & chrome_name(slug_any(stem(url), "")))


def parse(sources: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Columns of sources plus title, main_html and article_html. The title is read before anything is removed."""
    done = with_cleaned(sources, html, url, "_clean").withColumn("title", title(html)).withColumn("main_html", main("_clean"))
    return done.withColumn("article_html", article("main_html")).drop("_clean")


def first_only(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row for each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


