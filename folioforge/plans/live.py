"""One live page as a bundle: what is asked, in which order, and what is said about it meanwhile."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import web
from folioforge.functions.urls import skip_before_fetch
from folioforge.operators.extract import images
from folioforge.plans.bundle import bundles, main_links, main_pages, release
from folioforge.sources.captures import CHUNKS, assembled, classified
from folioforge.sources.http import fetch_chunks, image_bytes
from folioforge.sources.sinks import write_bundle
from folioforge.storage import collected, forget, stored


def say(line: str) -> None:
    print(line, file=sys.stderr)


#: Kinds of outcomes that are counted.
KINDS = ("readable", "asset", "failed", "alias", "skipped")


def save_page(spark: SparkSession, url: str, out_dir: str, *, progress: Callable[[str], None] = say, ask: Callable[..., DataFrame] = fetch_chunks) -> dict[str, int]:
    """Save a page and its direct references in out_dir; how many references there are of each kind.

    progress gets a line before the page and before each reference is asked,
    in link order, for each reference that is skipped unread, and once more for
    each that is skipped for what it turned out to be. A main page that fails
    raises RuntimeError with the reason, and out_dir stays as it was. ask: what
    answers addresses, piece by piece.
    """
    url = web.resolve(None, url) or url
    with collected() as steps:
        mains = spark.createDataFrame([(0, url)], "bundle_id long, url string")
        progress(f"Fetching main source {url} ...")
        first = stored(ask(mains))
        page = stored(classified(assembled(first)))
        row = page.select("fail_reason").first()
        if row.fail_reason:
            forget(*steps)
            raise RuntimeError(row.fail_reason)
        links = stored(main_links(main_pages(mains, page)).withColumn("unread", skip_before_fetch("main_url", "link_url")))
        for link in links.orderBy("pos").select("link_url", "unread").toLocalIterator():  # of one page
            progress(f"{'Skipping low-signal reference' if link.unread else 'Fetching reference source'} {link.link_url} ...")
        rest = ask(links.where("not unread").join(page.select(F.col("requested_url").alias("link_url")), "link_url", "left_anti"), "link_url")
        chunks = stored(first.unionByName(rest).select(*[c.split()[0] for c in CHUNKS.split(", ")]))
        sources = stored(assembled(chunks))
        shown = images(classified(sources).where("cls.kind = 'html'"), ["final_url"], "article_html", "final_url")
        pictures = stored(image_bytes(shown))
        tables = bundles(mains, sources, pictures, chunks)
        counted = Observation("outcomes")
        told = tables["outcomes"].observe(counted, *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
        # of one page; sorted here, as Spark's sort would read, and so count, everything twice
        for _, link in sorted(told.where("kind = 'skipped' and final_url is not null").select("pos", "link_url").collect()):
            progress(f"Skipping low-signal reference {link} ...")
        write_bundle(tables, 0, out_dir)
        release(tables)
    forget(*steps)
    return counted.get
