"""What becomes of each direct reference: skipped, fetched, failed or an alias; names, link map and manifest."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.operators.joins import join_popular
from folioforge.operators.names import allocate_names
from folioforge.storage import collected, forget, stored
from folioforge.functions.arrow import python_udf
from folioforge.functions.urls import document_key, is_homepage, is_known_landing, is_source_like, same_site, skip_before_fetch, title_from_url

SKIPPED = "low_signal_marketing_reference"
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Phrases that give marketing pages away.
SIGNALS = {
    "cta": "get started|start for free|try for free|sign up|signup|book a demo|contact sales",
    "social-proof": "trusted by|customers|customer stories|testimonials?|logo wall",
}


def marketing_signals(main_html, article_html) -> Column:
    """Array of the signals that a page's content shows."""
    m, a = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (main_html, article_html))
    html = F.when(m != "", m).otherwise(a)
    text = F.lower(F.regexp_replace(html, "<[^>]+>", " "))
    pricing = rf"(?s){_B}pricing{_E}|{_B}free{_E}.{{0,80}}{_B}(?:pro|enterprise){_E}"
    found = {
        "cta": text.rlike(f"{_B}(?:{SIGNALS['cta']}){_E}"),
        "social-proof": text.rlike(f"{_B}(?:{SIGNALS['social-proof']}){_E}"),
        "pricing": text.rlike(pricing),
        "form": html.rlike(rf"(?i)<form{_E}") | text.rlike(f"{_B}newsletter{_E}"),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in found.items()]))


def low_signal(main_url, reference_url, signals) -> Column:
    """Homepages and landing pages of other sites that show two signals or more, unless they look like sources."""
    return ~same_site(main_url, reference_url) & ~is_source_like(reference_url) & (is_homepage(reference_url) | is_known_landing(reference_url)) & (F.col(signals) >= 2)


def reference_title(cls_kind, cls_subtype, parsed_title, markdown_title, final_url) -> Column:
    by_url = title_from_url(final_url)
    parsed = F.col(parsed_title)
    return (
        F.when((F.col(cls_kind) == "html") & (F.trim(parsed) != "") & (parsed != "Untitled"), parsed)
        .when((F.col(cls_kind) == "text") & (F.col(cls_subtype) == "markdown"), F.coalesce(F.col(markdown_title), by_url))
        .otherwise(by_url)
    )


def resolve_references(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcome of each link.

    links: bundle_id, pos, main_url, link_url, link_label. sources, one row per
    requested_url: requested_url, fetched_url, final_url, content_type,
    fail_reason, cls (the class), parsed_title, markdown_title, main_html,
    article_html. Links that no source answers fail. Sources are joined after
    the links that are skipped unread have gone; of links that end at one
    document the first is kept and the others are aliases of it. The
    outcomes are stored, as each table of a bundle derives from them; steps on
    the way to them go again.
    """
    with collected() as steps:
        out = stored(_resolved(links, sources))
    forget(*(s for s in steps if s is not out))
    return out


def _resolved(links: DataFrame, sources: DataFrame) -> DataFrame:
    planned = stored(links.withColumn("unread", skip_before_fetch("main_url", "link_url")))
    # what the join carries of a source: no bodies, only how many signals they show, counted once for each source
    narrow = sources.select(
        F.col("requested_url").alias("link_url"), "fetched_url", "final_url", "content_type", "fail_reason", "cls", "parsed_title", "markdown_title",
        F.size(marketing_signals("main_html", "article_html")).alias("signals"),
    )
    answered = join_popular(planned.where("not unread"), narrow, "link_url", ["bundle_id", "pos"]).withColumn("requested_url", F.col("link_url"))
    failed = F.col("final_url").isNull() | F.col("fail_reason").isNotNull()
    title = F.when(failed, title_from_url("link_url")).otherwise(reference_title("cls.kind", "cls.subtype", "parsed_title", "markdown_title", "final_url"))
    answered = answered.withColumn("title", title).withColumn(
        "kind",
        F.when(failed, F.lit("failed"))
        .when((F.col("cls.kind") == "html") & low_signal("main_url", "final_url", "signals"), F.lit("skipped"))
        .when(F.col("cls.kind") == "asset", F.lit("asset"))
        .otherwise(F.lit("readable")),
    )
    answered = stored(answered)
    names = allocate_names(answered.where("kind <> 'skipped'"))
    answered = answered.join(names, ["bundle_id", "pos"], "left")

    keyed = answered.withColumn("final_key", F.when(F.col("kind").isin("readable", "asset"), document_key("final_url")))
    first = Window.partitionBy("bundle_id", "final_key").orderBy("pos")
    keyed = keyed.withColumn("_first", F.first(F.struct("pos", "relative_path")).over(first))
    alias = F.col("final_key").isNotNull() & (F.col("_first.pos") < F.col("pos"))
    base = F.regexp_extract("relative_path", r"([^/]*)\.md\z", 1)
    told = keyed.select(
        "bundle_id", "pos", "link_url", "link_label",
        F.when(alias, F.lit("alias")).otherwise(F.col("kind")).alias("kind"), "title",
        F.when(alias, F.col("_first.relative_path")).otherwise(F.col("relative_path")).alias("relative_path"),
        F.when(~alias & (F.col("kind") == "asset"), F.concat(F.lit("references/assets/"), base, F.col("cls.extension"))).alias("asset_path"),
        F.when(~failed, F.col("requested_url")).alias("requested_url"), F.when(~failed, F.col("fetched_url")).alias("fetched_url"), F.when(~failed, F.col("final_url")).alias("final_url"),
        F.when(~failed, F.col("content_type")).alias("content_type"), F.when(~failed, F.col("cls.kind")).alias("cls_kind"),
        F.when(F.col("kind") == "skipped", F.lit(SKIPPED)).alias("skipped_reason"),
        F.when(failed, F.coalesce("fail_reason", F.concat(F.lit("No response for "), "link_url"))).alias("fail_reason"),
    )
    none = lambda name: F.lit(None).cast("string").alias(name)
    unread = planned.where("unread").select(
        "bundle_id", "pos", "link_url", "link_label", F.lit("skipped").alias("kind"), none("title"), none("relative_path"), none("asset_path"),
        none("requested_url"), none("fetched_url"), none("final_url"), none("content_type"), none("cls_kind"), F.lit(SKIPPED).alias("skipped_reason"), none("fail_reason"),
    )
    return told.unionByName(unread)


def link_map(mains: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Where each address leads inside a bundle: bundle_id, key, relative_path, title; the last writer wins.

    mains: bundle_id, page_url, requested_url, fetched_url, final_url, title.
    Pages write in link order after the main page, and aliases after all pages.
    """
    urls = ["page_url", "requested_url", "fetched_url", "final_url"]
    main = mains.select("bundle_id", *urls, F.lit("index.md").alias("relative_path"), "title", F.lit(0).cast("long").alias("turn"))
    pages = outcomes.where("kind in ('readable', 'asset', 'failed')").select(
        "bundle_id", F.when(F.col("kind") == "failed", F.col("link_url")).otherwise(F.col("final_url")).alias("page_url"), "requested_url", "fetched_url", "final_url",
        "relative_path", "title", (F.col("pos") + 1).cast("long").alias("turn"),
    )
    first_title = Window.partitionBy("bundle_id", "relative_path")
    page_title = F.max(F.when(F.col("kind") != "alias", F.col("title"))).over(first_title)
    alias = outcomes.where("relative_path is not null").withColumn("title", page_title).where("kind = 'alias'").select(
        "bundle_id", F.col("link_url").alias("page_url"), "requested_url", "fetched_url", "final_url", "relative_path", "title", (F.col("pos") + F.lit(1 << 40)).cast("long").alias("turn")
    )
    entries = main.unionByName(pages).unionByName(alias)
    keys = F.array_compact(F.array(*[F.col(u) for u in urls], *[document_key(u) for u in urls]))
    spread = entries.select("bundle_id", "relative_path", "title", "turn", F.explode(F.array_distinct(keys)).alias("key"))
    return stored(spread.groupBy("bundle_id", "key").agg(F.max_by(F.struct("relative_path", "title"), "turn").alias("v")).select("bundle_id", "key", "v.relative_path", "v.title"))


def look_up(rows: DataFrame, links_to: DataFrame, url: str) -> DataFrame:
    """Add relative_path and title of the page at url, by the whole address or else without its fragment."""
    whole = links_to.select("bundle_id", F.col("key").alias(url), F.struct("relative_path", "title").alias("_whole"))
    bare = links_to.select("bundle_id", F.col("key").alias("_key"), F.struct("relative_path", "title").alias("_bare"))
    found = rows.withColumn("_key", document_key(url)).join(whole, ["bundle_id", url], "left").join(bare, ["bundle_id", "_key"], "left")
    return found.withColumn("_hit", F.coalesce("_whole", "_bare")).withColumn("relative_path", F.col("_hit.relative_path")).withColumn("title", F.col("_hit.title")).drop("_key", "_whole", "_bare", "_hit")


def reference_sections(links: DataFrame, links_to: DataFrame) -> DataFrame:
    """bundle_id and section: a list of the distinct local targets, in link order. No row for a bundle without any."""
    found = look_up(links.select("bundle_id", "pos", "link_url"), links_to, "link_url").where("relative_path is not null")
    first = found.groupBy("bundle_id", "relative_path").agg(F.min(F.struct("pos", "link_url", "title")).alias("f"))
    label = F.when(F.coalesce(F.col("f.title"), F.lit("")) == "", F.col("f.link_url")).otherwise(F.col("f.title"))
    lines = first.select("bundle_id", F.struct(F.col("f.pos").alias("pos"), F.concat(F.lit("- ["), label, F.lit("]("), "relative_path", F.lit(")")).alias("line")).alias("x"))
    listed = lines.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    return listed.select("bundle_id", F.concat(F.lit("## Direct References\n\n"), F.array_join("lines", "\n")).alias("section"))


def manifest_entries(outcomes: DataFrame) -> DataFrame:
    """One row per entry: bundle_id, pos, section (entries or skipped), key, entry (JSON without null fields)."""
    moved = F.when(F.col("final_url") != F.col("requested_url"), F.col("final_url"))
    pages = outcomes.where("kind in ('readable', 'asset', 'failed')")
    original = F.when(F.col("kind") == "failed", F.col("link_url")).otherwise(F.col("requested_url"))
    pages = pages.withColumn("original_url", original)
    others = outcomes.where("kind = 'alias'").join(pages.select("bundle_id", "relative_path", "original_url"), ["bundle_id", "relative_path"]).where("link_url <> original_url")
    others = others.groupBy("bundle_id", "relative_path").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link_url"))), lambda x: x["link_url"])).alias("additional_original_urls"))
    pages = pages.join(others, ["bundle_id", "relative_path"], "left")
    failed = F.col("kind") == "failed"
    entry = F.struct(
        "original_url", "title", F.when(failed, F.lit("")).otherwise(F.coalesce("content_type", F.lit(""))).alias("content_type"),
        F.when(failed | (F.col("kind") == "asset"), F.col("kind")).when(F.col("cls_kind") == "html", F.lit("html")).otherwise(F.lit("text")).alias("kind"),
        F.when(~failed, moved).alias("final_url"), "asset_path", "fail_reason", "additional_original_urls",
    )
    kept = pages.select("bundle_id", "pos", F.lit("entries").alias("section"), F.col("relative_path").alias("key"), F.to_json(entry).alias("entry"))
    some = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    skipped = F.struct(
        F.col("link_url").alias("original_url"), F.lit("skipped").alias("kind"), "skipped_reason", some("link_label").alias("label"), some("title"),
        F.when(F.col("final_url") != F.col("link_url"), F.col("final_url")).alias("final_url"), some("content_type"),
    )
    left = outcomes.where("kind = 'skipped'").select("bundle_id", "pos", F.lit("skipped").alias("section"), F.col("link_url").alias("key"), F.to_json(skipped).alias("entry"))
    return kept.unionByName(left)


def manifests(outcomes: DataFrame, bundles: DataFrame) -> DataFrame:
    """bundle_id and json: entries by path in link order, then the skipped ones under their addresses."""
    pair = F.concat(F.expr("substring(to_json(array(key)), 2, length(to_json(array(key))) - 2)"), F.lit(":"), F.col("entry"))
    rows = manifest_entries(outcomes).select("bundle_id", "section", F.struct("pos", pair.alias("pair")).alias("x"))
    lists = rows.groupBy("bundle_id").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.col("x")))), lambda x: x["pair"]).alias(s) for s in ("entries", "skipped")]
    )
    skipped = F.when(F.size("skipped") > 0, F.array(F.concat(F.lit('"skipped":{'), F.array_join("skipped", ","), F.lit("}")))).otherwise(F.array().cast("array<string>"))
    told = lists.select("bundle_id", F.concat(F.lit("{"), F.array_join(F.concat("entries", skipped), ","), F.lit("}")).alias("json"))
    return bundles.select("bundle_id").join(told, "bundle_id", "left").select("bundle_id", F.coalesce("json", F.lit("{}")).alias("json"))


#: Places of entries whose text is one part of a manifest's file.
RANGE = 4096


@python_udf(StringType())
def _entry_lines(key: pd.Series, entry: pd.Series, depth: pd.Series) -> pd.Series:
    """An entry as it stands in the file, by the indentation of its section."""

    def told(k: str, e: str, d: int) -> str:
        body = json.dumps(json.loads(e), indent=2, ensure_ascii=False)
        return "  " * d + f"{json.dumps(k, ensure_ascii=False)}: {body}".replace("\n", "\n" + "  " * d)

    return pd.Series([told(*x) for x in zip(key, entry, depth)], dtype=object)


def manifest_files(outcomes: DataFrame, bundles: DataFrame, places: int = RANGE) -> DataFrame:
    """The manifests' files in parts: bundle_id, chunk and text, as json.dumps with an indent of 2 writes what manifests() tells.

    A part holds the entries of so many places in a bundle, so no row grows with
    the bundle; what puts the parts together is the sink.
    """
    rows = manifest_entries(outcomes).withColumn("skipped", F.col("section") == "skipped")
    lines = rows.select("bundle_id", "skipped", F.floor(F.col("pos") / places).alias("range"), F.struct("pos", _entry_lines("key", "entry", F.when(F.col("skipped"), 2).otherwise(1)).alias("text")).alias("x"))
    parts = lines.groupBy("bundle_id", "skipped", "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), ",\n").alias("text"))
    keys = ["bundle_id", "skipped", "range"]
    order = Window.partitionBy("bundle_id").orderBy("skipped", "range")  # over the keys of parts, without their text
    numbered = lines.select(*keys).distinct().select(*keys, (F.row_number().over(order) - 1).alias("chunk"), F.lag("skipped").over(order).alias("first"), F.lead("skipped").over(order).isNull().alias("last"))
    first = F.col("first")
    before = F.when(first.isNull(), F.lit("{\n")).otherwise(F.lit(",\n"))
    opened = F.when(F.col("skipped") & (first.isNull() | ~first), F.lit('  "skipped": {\n')).otherwise(F.lit(""))
    after = F.when(~F.col("last"), F.lit("")).when(F.col("skipped"), F.lit("\n  }\n}\n")).otherwise(F.lit("\n}\n"))
    told = parts.join(numbered, keys).select("bundle_id", "chunk", F.concat(before, opened, "text", after).alias("text"))
    none = bundles.select("bundle_id").distinct().join(told.select("bundle_id"), "bundle_id", "left_anti")
    return told.unionByName(none.select("bundle_id", F.lit(0).alias("chunk"), F.lit("{}\n").alias("text")))
