"""Column functions over URLs that ``canonical`` has brought into the browsers' form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions import web
from folioforge.functions.arrow import python_udf
from folioforge.functions.text import col, let, slug

# Hosts, paths and extensions that the reference policy names.
KNOWN_HOMEPAGES = ["bolt.new", "descript.com", "qodo.ai", "braintrust.dev", "claude.ai"]
KNOWN_LANDINGS = ["anthropic.com/claude-code", "claude.com/product/claude-code", "claude.ai/code"]
SOURCE_HOSTS = ["github.com", "githubusercontent.com", "arxiv.org", "wikipedia.org"]
SOURCE_LABELS = ["docs", "help", "developer", "developers", "api"]
SOURCE_PREFIXES = "docs documentation guide guides api developer developers blog engineering research paper papers article articles case-studies customers".split()
SOURCE_EXTENSIONS = "md markdown txt json xml csv yaml yml js mjs cjs css ts tsx py go rs java pdf png jpg jpeg gif webp avif zip gz tar docx pptx xlsx".split()

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


@python_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link's absolute address, or null for links that lead to no document."""
    return pd.Series([web.normalize(b, h) for b, h in zip(base, href)], dtype=object)


@python_udf(StringType())
def resolve_asset(base: pd.Series, src: pd.Series) -> pd.Series:
    return pd.Series([web.asset_address(b, s) for b, s in zip(base, src)], dtype=object)


@python_udf(StringType())
def canonical(url: pd.Series) -> pd.Series:
    """The browsers' form of an absolute URL; null if it is none."""
    return pd.Series([None if u is None else web.resolve(None, u) for u in url], dtype=object)


def is_url(url) -> Column:
    return col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def raw_host(url) -> Column:
    return F.lower(F.regexp_extract(col(url), _AUTHORITY + r"(\[[^\]]*\]|[^/?#:]*)", 1))


def host(url) -> Column:
    """Host without a leading ``www.``; empty if there is none."""
    return F.regexp_replace(raw_host(url), r"^www\.", "")


def path(url) -> Column:
    found = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.when(col(url).rlike("://"), F.lit("/")).otherwise(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:([^?#]*)", 1))).otherwise(found)


def trimmed_path(url) -> Column:
    cut = F.regexp_replace(path(url), r"/+\z", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def document_key(url) -> Column:
    """The URL without its fragment: what tells documents apart."""
    return F.regexp_replace(col(url), r"(?s)#.*\z", "")


def base_name(url) -> Column:
    return F.regexp_extract(F.regexp_replace(path(url), r"/+\z", ""), r"([^/]*)\z", 1)


def _extension_of(name: Column) -> Column:
    """From the last dot of a file name on, unless the dot starts the name."""
    return F.regexp_extract(name, r"[^/](\.[^./]*)\z", 1)


def stem(url) -> Column:
    name = base_name(url)
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*\z", "")


def extension(url, longest: int = 12) -> Column:
    """Lower-cased extension with its dot; null if there is none or it is too long."""
    found = F.lower(_extension_of(base_name(url)))
    return F.when((found != "") & (F.length(found) <= longest), found)


def title_from_url(url) -> Column:
    name = base_name(url)
    return F.when(~is_url(url), col(url)).otherwise(F.regexp_replace(F.when(name == "", raw_host(url)).otherwise(name), r"[-_]+", " "))


def is_ip(host_column) -> Column:
    return col(host_column).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z") | col(host_column).contains(":")


def registrable_domain(host_column) -> Column:
    """The last two labels; no list of public suffixes is used."""

    def cut(h: Column) -> Column:
        labels = F.filter(F.split(h, r"\."), lambda x: x != "")
        return let(labels, lambda n: F.when((h == "") | is_ip(h) | (F.size(n) <= 2), h).otherwise(F.concat_ws(".", F.slice(n, -2, 2))))

    return let(F.regexp_replace(col(host_column), r"\.\z", ""), cut)


def same_site(left, right) -> Column:
    def same(a: Column, b: Column) -> Column:
        return F.when((a == "") | (b == ""), F.lit(True)).when(is_ip(a) | is_ip(b), a == b).otherwise(registrable_domain(a) == registrable_domain(b))

    return let(host(left), lambda a: let(host(right), lambda b: same(a, b)))


def is_homepage(url) -> Column:
    return is_url(url) & trimmed_path(url).isin("/", "/home")


def is_known_landing(url) -> Column:
    landing = lambda h: (h.isin(KNOWN_HOMEPAGES) & is_homepage(url)) | F.concat(h, F.lower(trimmed_path(url))).isin(KNOWN_LANDINGS)
    return let(host(url), landing)


def is_source_like(url) -> Column:
    hosts = r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in SOURCE_HOSTS) + r")\z"
    by_host = let(host(url), lambda h: h.rlike(hosts) | F.get(F.split(h, r"\."), F.lit(0)).isin(SOURCE_LABELS))
    by_path = F.lower(trimmed_path(url)).rlike("^/(" + "|".join(SOURCE_PREFIXES) + r")(/|\z)")
    return ~is_url(url) | by_host | by_path | F.lower(_extension_of(base_name(url))).isin(["." + x for x in SOURCE_EXTENSIONS])


def skip_before_fetch(main, reference) -> Column:
    """Known landing pages of other sites, unless they look like sources."""
    return ~same_site(main, reference) & ~is_source_like(reference) & is_known_landing(reference)


def content_type_base(content_type) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(col(content_type), F.lit("")), F.lit(";"), F.lit(1))))


def validation_error(url) -> Column:
    """Why a source URL is refused; null if it is not."""
    u = col(url)
    return (
        F.when(~is_url(u) | (scheme(u).isin("http", "https") & (raw_host(u) == "")), F.concat(F.lit("Invalid source URL: "), u))
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@"), F.lit("Invalid source URL: username and password are not allowed"))
        .when(~scheme(u).isin("http", "https"), F.lit("Invalid source URL: protocol must be http or https"))
        .when(~F.contains(raw_host(u), F.lit(".")), F.lit("Invalid source URL: hostname must contain a dot"))
    )


def upgraded(url) -> Column:
    """https for http, on a first request only; a port that was named stays."""
    return F.regexp_replace(F.regexp_replace(col(url), "^http:", "https:"), r"^(https://[^/?#]*):443(?=[/?#]|\z)", "$1")


def chrome_name(name) -> Column:
    """Whether a slug names a piece of decoration."""
    return F.arrays_overlap(F.split(col(name), "-"), F.array(*[F.lit(x) for x in ("logo", "icon", "avatar", "pixel", "spacer", "badge")]))


def chrome_image(url, alt) -> Column:
    return chrome_name(slug(alt, "")) | (is_url(url) & chrome_name(slug(stem(url), "")))


