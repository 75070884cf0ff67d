"""Queries of the page-bundle engine and their SQL oracles, by name.

The driver's pages hold no links, images or references outside their
furniture, so some queries build captures from the tables' columns: the same
strings in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import classify as C
from folioforge.functions import text as T
from folioforge.functions import urls as U
from folioforge.operators import assets, balance, chrome, extract, names, outcomes, render
from folioforge.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", "html")


# Pieces of the oracles.
_PLAIN = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_DECODED = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"


def _tags(x: str) -> str:
    return _DECODED.format(_PLAIN.format(x))


_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_WWW = "regexp_replace(" + _HOST + ", '^www\\.', '')"
_PATH = "coalesce(nullif(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_TRIMMED = "coalesce(nullif(regexp_replace(" + _PATH + ", '/+$', ''), ''), '/')"
_BASE = "regexp_extract(regexp_replace(" + _PATH + ", '/+$', ''), '([^/]*)$', 1)"
_EXT = "lower(regexp_extract(" + _BASE + ", '[^/](\\.[^./]*)$', 1))"
_TITLE_URL = "regexp_replace(coalesce(nullif(" + _BASE + ", ''), " + _HOST + "), '[-_]+', ' ', 'g')"
_DOMAIN = "array_to_string(list_slice(string_split(" + _WWW + ", '.'), -2, -1), '.')"
_ARTICLE = "CASE WHEN regexp_matches({0}, '(?is)<article\\b[^>]*>.*?</article>') THEN regexp_extract({0}, '(?is)<article\\b[^>]*>(.*?)</article>', 1) ELSE {0} END"
_MAIN = "CASE WHEN regexp_matches({0}, '(?is)<main\\b[^>]*>.*?</main>') THEN regexp_extract({0}, '(?is)<main\\b[^>]*>(.*?)</main>', 1) WHEN regexp_matches({0}, '(?is)<body\\b[^>]*>.*?</body>') THEN regexp_extract({0}, '(?is)<body\\b[^>]*>(.*?)</body>', 1) ELSE {0} END"
_TITLE = (
    "CASE WHEN regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) <> '' THEN " + _tags("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
    + " WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN trim(" + _tags("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ") ELSE 'Untitled' END"
)
_SLUG = "trim(lower(regexp_replace(replace(regexp_replace({0}, '[''’]', '', 'g'), '&', ' and '), '[^a-zA-Z0-9]+', '-', 'g')), '-')"


@query(f"SELECT page_id, {_TITLE} AS title, {_tags(_ARTICLE.format('html'))} AS article_text, regexp_replace(url, '#.*', '') AS doc_key, {_WWW.format('url')} AS host, CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def page_text(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("page_id", extract.title("html").alias("title"), T.strip_tags(extract.article("html")).alias("article_text"), U.document_key("url").alias("doc_key"), U.host("url").alias("host"), F.length("html").cast("long").alias("n_chars"))


@query(f"SELECT page_id, md5({_MAIN.format('html')}) AS main_md5, md5({_ARTICLE.format('html')}) AS article_md5 FROM pages")
def page_content(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(extract.main("html")).alias("main_md5"), F.md5(extract.article("html")).alias("article_md5"))


@query(f"SELECT page_id, {_PATH.format('url')} AS path, {_TRIMMED.format('url')} AS trimmed_path, nullif(CASE WHEN length({_EXT.format('url')}) <= 12 THEN {_EXT.format('url')} END, '') AS extension, {_TITLE_URL.format('url')} AS url_title, {_DOMAIN.format('url')} AS domain, {_TRIMMED.format('url')} IN ('/', '/home') AS is_homepage FROM pages")
def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", U.path("url").alias("path"), U.trimmed_path("url").alias("trimmed_path"), U.extension("url").alias("extension"), U.title_from_url("url").alias("url_title"),
        U.registrable_domain(U.host("url")).alias("domain"), U.is_homepage("url").alias("is_homepage"),
    )


#: Each page beside one 97 further on: a pair of addresses for the policies.
_PAIRS = "SELECT a.page_id, a.url AS main_url, b.url AS ref_url FROM pages a JOIN pages b ON b.page_id = (a.page_id * 7 + 3) % (SELECT max(page_id) + 1 FROM pages)"


def _pairs(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "url")
    most = p.agg((F.max("page_id") + 1).alias("n"))
    a = p.crossJoin(F.broadcast(most)).select("page_id", F.col("url").alias("main_url"), ((F.col("page_id") * 7 + 3) % F.col("n")).alias("other"))  # one row
    return a.join(p.select(F.col("page_id").alias("other"), F.col("url").alias("ref_url")), "other").drop("other")


@query(f"SELECT page_id, {_DOMAIN.format('main_url')} = {_DOMAIN.format('ref_url')} AS same_site FROM ({_PAIRS})")
def same_site(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page_id", U.same_site("main_url", "ref_url").alias("same_site"))


_PREFIXES = "|".join(U.SOURCE_PREFIXES)
_LIKE = (
    f"regexp_matches({_WWW.format('{0}')}, '(^|\\.)(github\\.com|githubusercontent\\.com|arxiv\\.org|wikipedia\\.org)$') OR string_split({_WWW.format('{0}')}, '.')[1] IN ('docs', 'help', 'developer', 'developers', 'api')"
    f" OR regexp_matches(lower({_TRIMMED.format('{0}')}), '^/({_PREFIXES})(/|$)') OR {_EXT.format('{0}')} IN ({', '.join(repr('.' + e) for e in U.SOURCE_EXTENSIONS)})"
)
_LANDING = (
    f"(({_WWW.format('{0}')} IN ({', '.join(map(repr, U.KNOWN_HOMEPAGES))}) AND {_TRIMMED.format('{0}')} IN ('/', '/home')) OR {_WWW.format('{0}')} || lower({_TRIMMED.format('{0}')}) IN ({', '.join(map(repr, U.KNOWN_LANDINGS))}))"
)
#: Addresses that the policies treat differently, on the paths of the pages.
_POLICY_HOSTS = ["bolt.new", "www.descript.com", "docs.example.org", "github.com", "sub.arxiv.org", "claude.ai", "shop.example.org", "10.0.0.1", "anthropic.com"]
_POLICY_PATHS = ["/", "/home/", "/blog/x", "/claude-code", "/code", "/file.PDF", "/pricing", "/docs", "/a/b?c=/d#e"]
_POLICY = (
    "SELECT page_id, url AS main_url, 'https://' || (" + "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_POLICY_HOSTS)) + " END) || (CASE page_id // 9 % 9 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_POLICY_PATHS)) + " END) AS ref_url, html FROM pages"
)


def _policy(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    k = F.col("page_id")
    return pages(spark, sf_dir).select("page_id", F.col("url").alias("main_url"), F.concat(F.lit("https://"), pick(_POLICY_HOSTS, k % 9), pick(_POLICY_PATHS, F.floor(k / 9) % 9)).alias("ref_url"), "html")


_SAME = (
    f"CASE WHEN regexp_matches({_WWW.format('main_url')}, '^[0-9]+(\\.[0-9]+){{3}}$') OR regexp_matches({_WWW.format('ref_url')}, '^[0-9]+(\\.[0-9]+){{3}}$') THEN {_WWW.format('main_url')} = {_WWW.format('ref_url')} ELSE {_DOMAIN.format('main_url')} = {_DOMAIN.format('ref_url')} END"
)


@query(f"SELECT page_id, ref_url, ({_LIKE.format('ref_url')}) AS source_like, {_LANDING.format('ref_url')} AS known_landing, NOT ({_SAME}) AND NOT ({_LIKE.format('ref_url')}) AND {_LANDING.format('ref_url')} AS skipped FROM ({_POLICY})")
def prefetch_policy(spark, sf_dir):
    p = _policy(spark, sf_dir)
    return p.select("page_id", "ref_url", U.is_source_like("ref_url").alias("source_like"), U.is_known_landing("ref_url").alias("known_landing"), U.skip_before_fetch("main_url", "ref_url").alias("skipped"))


#: What may be asked for, made from each page's address: as it is, with a password, another scheme, a port, and what is no address of a source.
_ASKED = [
    "{url}", "replace({url}, '://', '://user:pw@')", "replace({url}, 'https://', 'ftp://')", "concat('https://localhost/', {id})", "concat('no url ', {id})",
    "replace(replace({url}, 'https://', 'http://'), '.example.', '.example.org:8080.')", "concat('mailto:', {id}, '@b.c')", "concat('https://[::1]/', {id})", "replace({url}, 'https://', 'http://')",
]
_ASKED_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {k} THEN {e.format(url='url', id='page_id')}" for k, e in enumerate(_ASKED)) + " END"


@query(
    "SELECT page_id, u, CASE WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'Invalid source URL: ' || u WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') THEN 'Invalid source URL: username and password are not allowed'"
    " WHEN NOT regexp_matches(u, '^https?:') THEN 'Invalid source URL: protocol must be http or https' WHEN NOT regexp_matches(u, '^https?://[^/?#:]*\\.') THEN 'Invalid source URL: hostname must contain a dot' END AS refused, regexp_replace(u, '^http:', 'https:') AS upgraded"
    f" FROM (SELECT page_id, {_ASKED_SQL} AS u FROM pages)"
)
def validate_url(spark, sf_dir):
    u = pages(spark, sf_dir).select("page_id", F.expr(_ASKED_SQL).alias("u"))
    return u.select("page_id", "u", U.validation_error("u").alias("refused"), U.upgraded("u").alias("upgraded"))


_TYPES = ["text/html; charset=utf-8", "application/xhtml+xml", "Text/Markdown", "text/plain", "application/json", "application/ld+json", "application/rss+xml", "image/svg+xml", "text/javascript", "application/x-www-form-urlencoded", "text/css", "text/csv", "text/x-rst; a=b", "image/png", "application/pdf", "application/yaml", "application/gzip"]
_TYPE_BASE = "lower(trim(string_split(ct, ';')[1]))"


@query(
    f"""SELECT page_id, ct, CASE WHEN b IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN b LIKE 'text/%' OR b LIKE '%+json' OR b LIKE '%+xml' OR b IN ('application/json', 'application/xml', 'application/javascript', 'application/x-www-form-urlencoded') THEN 'text' ELSE 'asset' END AS kind,
    CASE WHEN b IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN b = 'text/plain' THEN 'plain' WHEN b = 'application/json' OR b LIKE '%+json' THEN 'json' WHEN b = 'application/xml' OR b LIKE '%+xml' THEN 'xml' WHEN b IN ('application/javascript', 'text/javascript') THEN 'javascript' WHEN b = 'application/x-www-form-urlencoded' THEN 'form' WHEN b LIKE 'text/%' THEN b[6:] ELSE b END AS subtype,
    CASE b WHEN 'text/html' THEN '.html' WHEN 'application/xhtml+xml' THEN '.html' WHEN 'text/markdown' THEN '.md' WHEN 'text/javascript' THEN '.js' WHEN 'text/css' THEN '.css' WHEN 'text/csv' THEN '.csv' WHEN 'image/png' THEN '.png' WHEN 'application/pdf' THEN '.pdf' WHEN 'application/gzip' THEN '.gz' WHEN 'application/yaml' THEN '.bin'
    ELSE CASE WHEN b = 'application/json' OR b LIKE '%+json' THEN '.json' WHEN b LIKE '%+xml' THEN '.xml' ELSE '.txt' END END AS extension FROM (SELECT page_id, ct, {_TYPE_BASE} AS b FROM (SELECT page_id, list_extract([{', '.join(map(repr, _TYPES))}], CAST(page_id % {len(_TYPES)} + 1 AS INT)) AS ct FROM pages))"""
)
def classify_header(spark, sf_dir):
    t = pages(spark, sf_dir).withColumn("ct", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("page_id") % len(_TYPES) + 1).cast("int")))
    return t.withColumn("c", C.classify("ct", F.lit("https://example.com/x"), F.col("html").cast("binary"))).select("page_id", "ct", "c.kind", "c.subtype", "c.extension")


_EXTS = ["html", "HTM", "md", "markdown", "txt", "json", "rss", "mjs", "css", "csv", "yml", "pdf", "jpeg", "docx"]
_EXT_KIND = {"html": "html", "htm": "html", "pdf": "asset", "jpeg": "asset", "docx": "asset"}
_EXT_SUB = {"htm": "html", "md": "markdown", "txt": "plain", "rss": "xml", "mjs": "javascript", "yml": "yaml", "pdf": "application/pdf", "jpeg": "binary", "docx": "binary"}


@query(
    "SELECT page_id, ext, CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXT_KIND.items()) + " ELSE 'text' END AS kind, CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXT_SUB.items())
    + " ELSE lower(ext) END AS subtype FROM (SELECT page_id, list_extract([" + ", ".join(map(repr, _EXTS)) + f"], CAST(page_id % {len(_EXTS)} + 1 AS INT)) AS ext FROM pages)"
)
def classify_extension(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("page_id") % len(_EXTS) + 1).cast("int")).alias("ext"))
    url = F.concat(F.lit("https://example.com/dir/name."), "ext", F.lit("?x=1"))
    return p.withColumn("c", C.classify(F.lit("application/octet-stream"), url, F.lit(None).cast("binary"))).select("page_id", "ext", "c.kind", "c.subtype")


#: What stands before each page's bytes: magic numbers, two ways HTML begins, a NUL, half a character, a control character, nothing.
_BYTES = ["255044462D312E37", "89504E470D0A1A0A00", "FFD8FFE000", "474946383961AA", "52494646000000005745425056", "504B0304", "3C21444F43545950452068746D6C3E", "20203C48544D4C3E", "68656C6C6F", "680065", "C3", "1B41", ""]
_BYTES_SQL = "CASE page_id % 13 " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(_BYTES)) + " END"
#: Of the first 4096 bytes, in hex: whether they hold a NUL or control character, half a character at either end, and begin as HTML does.
_ODD_BYTES = "(regexp_matches(s, '^(..)*(0[0-8EF]|1[0-9A-F])') OR regexp_matches(s, '^C3[^89AB]') OR (n > 4096 AND regexp_matches(s, '([C-F].|[EF]...|F.....)$')))"
_HTML_BYTES = "(p IN ('3C21444F43545950452068746D6C3E', '20203C48544D4C3E') OR (p = '' AND regexp_matches(html, '(?i)^\\s*<(!doctype html|html)')))"


@query(
    f"""SELECT page_id, n, CASE WHEN magic IS NOT NULL OR {_ODD_BYTES} THEN 'asset' WHEN {_HTML_BYTES} THEN 'html' ELSE 'text' END AS kind,
    CASE WHEN magic IS NOT NULL THEN magic WHEN {_ODD_BYTES} THEN 'binary' WHEN {_HTML_BYTES} THEN 'html' ELSE 'plain' END AS subtype
    FROM (SELECT *, CAST(length(hx) // 2 AS BIGINT) AS n, hx[:8192] AS s, CASE p WHEN '255044462D312E37' THEN 'application/pdf' WHEN '89504E470D0A1A0A00' THEN 'image/png' WHEN 'FFD8FFE000' THEN 'image/jpeg'
      WHEN '474946383961AA' THEN 'image/gif' WHEN '52494646000000005745425056' THEN 'image/webp' WHEN '504B0304' THEN 'application/zip' END AS magic
      FROM (SELECT *, p || hex(encode(html)) AS hx FROM (SELECT page_id, html, {_BYTES_SQL} AS p FROM pages)))"""
)
def classify_bytes(spark, sf_dir):
    """Whole pages behind the bytes that other files begin with."""
    t = pages(spark, sf_dir).withColumn("b", F.concat(F.unhex(F.expr(_BYTES_SQL)), F.col("html").cast("binary")))
    return t.withColumn("c", C.classify(F.lit(""), F.lit("https://example.com/x"), F.col("b"))).select("page_id", F.length("b").cast("long").alias("n"), "c.kind", "c.subtype")


#: Headers of images of every kind, whose sides follow from the page, before the page's bytes: w and h big-endian, x and y little-endian, in hex.
_HEADERS = {
    "png": "'89504E470D0A1A0A0000000D49484452', '0000', w, '0000', h, '0802'",
    "gif": "'474946383961', x, y, '0000'",
    "jpeg": "'FFD8FFE000104A46494600010100000100010000', 'FFE1000611223344', 'FFFFC2001108', h, w, '03'",
    "webp": "'524946460000000057454250', '56503820', '00000000', '000000', '9D012A', x, y",
    "webp_lossless": "'524946460000000057454250', '5650384C', '00000000', '2F', x, '00', '00'",
    "webp_extended": "'524946460000000057454250', '56503858', '0A000000', '00000000', x, '00', y, '00'",
    "svg": "'3C7376672077696474683D22', dw, '22206865696768743D27', dh, '7078273E'",
    "heif": "'0000001866747970686569630000'",
    "short": "'89504E47'",
}
_SIDES = "1 + page_id % 700 AS width, 1 + page_id * 7 % 600 AS height"
_HEADER_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {k} THEN concat({e})" for k, e in enumerate(_HEADERS.values())) + " END"
_DIGITS_SQL = "concat('3', substr({0}, 1, 1), '3', substr({0}, 2, 1), '3', substr({0}, 3, 1))"
_PARTS = [
    "substr(hw, 5, 4) AS w", "substr(hh, 5, 4) AS h", "concat(substr(hw, 7, 2), substr(hw, 5, 2)) AS x", "concat(substr(hh, 7, 2), substr(hh, 5, 2)) AS y",
    f"{_DIGITS_SQL.format('lw')} AS dw", f"{_DIGITS_SQL.format('lh')} AS dh",
]


@query(
    """SELECT page_id, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' WHEN 6 THEN 'svg' WHEN 7 THEN 'heif' WHEN 8 THEN NULL ELSE 'webp' END AS format,
    CASE WHEN k IN (7, 8) THEN 0 WHEN k = 4 THEN 1 + width % 16384 WHEN k = 5 THEN 1 + width ELSE width END AS width, CASE WHEN k IN (7, 8) THEN 0 WHEN k = 4 THEN 1 + width // 16384 WHEN k = 5 THEN 1 + height ELSE height END AS height,
    CASE WHEN k IN (7, 8) THEN false ELSE least(CASE WHEN k = 4 THEN 1 ELSE height + CAST(k = 5 AS INT) END, width + CAST(k IN (4, 5) AS INT)) < 24 OR greatest(CASE WHEN k = 4 THEN 1 ELSE height + CAST(k = 5 AS INT) END, width + CAST(k IN (4, 5) AS INT)) <= 64 END AS tiny"""
    f" FROM (SELECT page_id, page_id % 9 AS k, {_SIDES} FROM pages)"
)
def image_headers(spark, sf_dir):
    sides = pages(spark, sf_dir).select("page_id", "html", *[F.expr(e) for e in _SIDES.split(", ")])
    hexed = sides.select("page_id", "html", F.format_string("%08X", "width").alias("hw"), F.format_string("%08X", "height").alias("hh"), F.format_string("%03d", "width").alias("lw"), F.format_string("%03d", "height").alias("lh"))
    parts = hexed.selectExpr("page_id", "html", *_PARTS)
    b = parts.withColumn("b", F.when(F.col("page_id") % 9 == 8, F.unhex(F.expr(_HEADER_SQL))).otherwise(F.concat(F.unhex(F.expr(_HEADER_SQL)), F.col("html").cast("binary"))))
    told = b.withColumn("size", C.image_size("b"))
    zero = lambda c: F.coalesce(told["size"][c], F.lit(0)).cast("long").alias(c)
    return told.select("page_id", C.image_format("b").alias("format"), zero("width"), zero("height"), F.coalesce(C.tiny(told["size"]["width"], told["size"]["height"]), F.lit(False)).alias("tiny"))


_WITHOUT = "html"
for _t in ("nav", "header", "footer", "aside"):
    _WITHOUT = f"regexp_replace({_WITHOUT}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', '', 'g')"


@query(f"SELECT page_id, md5({_WITHOUT}) AS html_md5 FROM pages")
def strip_chrome(spark, sf_dir):
    """The pages' furniture is balanced and not nested, which plain expressions can remove as well."""
    return pages(spark, sf_dir).select("page_id", F.md5(chrome.without_furniture("html")).alias("html_md5"))


_CLEAN = "html"
for _t in ("script", "style", "noscript", "svg", "aside"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', '', 'g')"
for _t in ("class", "style"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?i)\\s{_t}=\"[^\"]*\"', '', 'g')"


@query(f"SELECT page_id, md5({_CLEAN}) AS clean_md5, md5(CASE WHEN regexp_matches(html, '(?is)<h1[^>]*>.*?</h1>') THEN ltrim(regexp_replace(html, '(?is)<h1[^>]*>.*?</h1>', ''), E' \\t\\n\\r') ELSE html END) AS bodied_md5 FROM pages")
def clean_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(extract.clean("html")).alias("clean_md5"), F.md5(extract.without_first_h1("html")).alias("bodied_md5"))


#: Every page on four hosts with rules of their own, with what those rules cut.
_SITES = ["arxiv.org", "en.wikipedia.org", "github.com", "bolt.new"]
_MARKUP = [
    '<div class="subheader">a<div>b</div></div><p>kept</p><h3>References &amp; Citations</h3><p>cut</p>',
    '<div class="mw-content-ltr mw-parser-output"><p>kept</p><div class="reflist">x</div><div class="mw-heading mw-heading2"><h2 id="References">R</h2></div><p>cut</p></div> <noscript>n</noscript>',
    '<p>out</p><article class="markdown-body entry">kept</article><p>out</p>',
    "<h1>T</h1><button>b</button><p>kept</p><p> or import from </p><h2>Ready to build something amazing?</h2><p>cut</p>",
]
_RESULT = ["<p>kept</p>", "<p>kept</p>", '<main><article><article class="markdown-body entry">kept</article></article></main>', "<h2>T</h2><p>kept</p></body></html>"]


@query(
    "SELECT page_id, CASE page_id % 5 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RESULT)) + " ELSE '" + _MARKUP[3] + "' END AS cleaned FROM pages"
)
def site_rules(spark, sf_dir):
    at = (F.col("page_id") % 5 + 1).cast("int")
    p = pages(spark, sf_dir).select("page_id", F.element_at(F.array(*map(F.lit, [*_MARKUP, _MARKUP[3]])), at).alias("html"), F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, [*_SITES, "example.com"])), at), F.lit("/x")).alias("url"))
    return p.select("page_id", chrome.with_site_rules("html", "url").alias("cleaned"))


@query("""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]+)"[^>]*>.*?</a>', 1)) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%3A', ':') AS link_url, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL""")
def nav_links(spark, sf_dir):
    """Anchors of the whole pages, furniture included, resolved against their pages."""
    p = pages(spark, sf_dir).select("page_id", "url", F.explode(extract.raw_links("html")).alias("a"))
    return p.select("page_id", U.resolve("url", "a.href").alias("link_url")).groupBy("page_id", "link_url").agg(F.count("*").alias("n"))


#: Pages whose articles link to others: to the next, to the one after it without and with a label, and by mail.
_LINKED = """linked AS (SELECT page_id, u AS url, '<html><body><nav><a href="/chrome">c</a></nav><article><h1>Page ' || page_id || '</h1><p><a href="' || n1 || '">One</a> <a href="' || n2 || '#s"><b></b></a> <a href="' || n2 || '">Two</a> <a href="mailto:x@example.com">m</a></p></article></body></html>' AS html, n1, n2
  FROM (SELECT page_id, 'https://site' || page_id % 11 || '.example.org/p/' || page_id AS u, 'https://site' || (page_id + 1) % 11 || '.example.org/p/' || (page_id + 1) AS n1, 'https://site' || (page_id + 2) % 11 || '.example.org/p/' || (page_id + 2) AS n2 FROM pages))"""


def linked(spark, sf_dir):
    at = lambda k: F.concat(F.lit("https://site"), ((F.col("page_id") + k) % 11).cast("string"), F.lit(".example.org/p/"), (F.col("page_id") + k).cast("string"))
    p = read(spark, sf_dir, "pages").select("page_id", at(0).alias("url"), at(1).alias("n1"), at(2).alias("n2"))
    html = F.concat(
        F.lit('<html><body><nav><a href="/chrome">c</a></nav><article><h1>Page '), F.col("page_id").cast("string"), F.lit('</h1><p><a href="'), "n1", F.lit('">One</a> <a href="'), "n2", F.lit('#s"><b></b></a> <a href="'), "n2",
        F.lit('">Two</a> <a href="mailto:x@example.com">m</a></p></article></body></html>'),
    )
    return p.select("page_id", "url", html.alias("html"))


@query(f"""WITH {_LINKED}
SELECT page_id, CAST(0 AS INT) AS pos, n1 AS link_url, 'One' AS link_label, n1 AS doc_key FROM linked UNION ALL SELECT page_id, 1, n2 || '#s', 'Two', n2 FROM linked""")
def links_dedup(spark, sf_dir):
    found = extract.parse(linked(spark, sf_dir))
    return extract.links(found, ["page_id"], "article_html", "url")


def _linked_sources(spark, sf_dir) -> DataFrame:
    """Responses to the linked pages: those divisible by 5 are missing, by 7 end at the page before, by 6 are PDF."""
    p = linked(spark, sf_dir).where("page_id % 5 <> 0")
    before = F.concat(F.lit("https://site"), ((F.col("page_id") - 1) % 11).cast("string"), F.lit(".example.org/p/"), (F.col("page_id") - 1).cast("string"))
    final = F.when(F.col("page_id") % 7 == 0, before).otherwise(F.col("url"))
    pdf = F.col("page_id") % 6 == 0
    return p.select(
        F.explode(F.array("url", F.concat("url", F.lit("#s")))).alias("requested_url"), final.alias("final_url"), F.when(pdf, F.lit("application/pdf")).otherwise(F.lit("text/html")).alias("content_type"),
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("parsed_title"), F.col("html").alias("main_html"), F.col("html").alias("article_html"),
    ).withColumn("fetched_url", F.col("requested_url")).withColumn("fail_reason", F.lit(None).cast("string")).withColumn("markdown_title", F.lit(None).cast("string")).withColumn("cls", C.classify("content_type", "final_url", F.lit(None).cast("binary")))


def _links(spark, sf_dir) -> DataFrame:
    return stored(links_dedup(spark, sf_dir))


def _told(spark, sf_dir, links: DataFrame | None = None) -> DataFrame:
    found = (links or _links(spark, sf_dir)).join(linked(spark, sf_dir).select("page_id", F.col("url").alias("main_url")), "page_id")
    return outcomes.resolve_references(found.withColumnRenamed("page_id", "bundle_id"), _linked_sources(spark, sf_dir))


_OUTCOMES = f"""{_LINKED},
ref AS (SELECT page_id AS bundle_id, 0 AS pos, n1 AS link_url, 'One' AS link_label, page_id + 1 AS t FROM linked UNION ALL SELECT page_id, 1, n2 || '#s', 'Two', page_id + 2 FROM linked),
got AS (SELECT r.*, t % 5 = 0 OR t > (SELECT max(page_id) FROM pages) AS failed, CASE WHEN t % 7 = 0 THEN t - 1 ELSE t END AS f FROM ref r),
named AS (SELECT *, 'https://site' || f % 11 || '.example.org/p/' || f AS final_url,
  CASE WHEN failed THEN CAST(t AS VARCHAR) WHEN t % 6 = 0 THEN CAST(f AS VARCHAR) ELSE 'Page ' || t END AS title,
  CASE WHEN failed THEN 'failed' WHEN t % 6 = 0 THEN 'asset' ELSE 'readable' END AS kind0 FROM got),
based AS (SELECT *, lower(replace(title, ' ', '-')) AS base FROM named),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, base ORDER BY pos) AS k FROM based),
placed AS (SELECT *, 'references/' || base || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS path0, CASE WHEN NOT failed THEN final_url END AS fk FROM numbered),
told AS (SELECT *, CASE WHEN fk IS NOT NULL AND first_value(pos) OVER w < pos THEN 'alias' ELSE kind0 END AS kind, CASE WHEN fk IS NOT NULL THEN first_value(path0) OVER w ELSE path0 END AS relative_path FROM placed WINDOW w AS (PARTITION BY bundle_id, fk ORDER BY pos))"""


@query(f"WITH {_OUTCOMES} SELECT bundle_id, CAST(pos AS INT) AS pos, link_url, kind, title, relative_path, CASE WHEN kind = 'asset' THEN replace(replace(relative_path, 'references/', 'references/assets/'), '.md', '.pdf') END AS asset_path, CASE WHEN NOT failed THEN final_url END AS final_url, CASE WHEN failed THEN 'No response for ' || link_url END AS fail_reason FROM told")
def reference_outcomes(spark, sf_dir):
    return _told(spark, sf_dir).select("bundle_id", "pos", "link_url", "kind", "title", "relative_path", "asset_path", "final_url", "fail_reason")


_MAP = f"""{_OUTCOMES},
mains AS (SELECT page_id AS bundle_id, url AS u, 'index.md' AS path, CAST(-1 AS BIGINT) AS turn FROM linked),
paged AS (SELECT bundle_id, unnest(CASE WHEN failed THEN [link_url] ELSE [final_url, link_url] END) AS u, relative_path AS path, CAST(pos AS BIGINT) AS turn FROM told WHERE kind <> 'alias'),
aliased AS (SELECT bundle_id, unnest([link_url, final_url]) AS u, relative_path AS path, pos + 1000000 AS turn FROM told WHERE kind = 'alias'),
entries AS (SELECT bundle_id, unnest([u, regexp_replace(u, '#.*', '')]) AS key, path, turn FROM (SELECT * FROM mains UNION ALL SELECT * FROM paged UNION ALL SELECT * FROM aliased)),
lm AS (SELECT bundle_id, key, arg_max(path, turn) AS relative_path FROM entries GROUP BY ALL)"""


def _map(spark, sf_dir, links: DataFrame | None = None):
    mains = linked(spark, sf_dir).select(F.col("page_id").alias("bundle_id"), F.col("url").alias("page_url"), F.col("url").alias("requested_url"), F.col("url").alias("fetched_url"), F.col("url").alias("final_url"), F.lit("main").alias("title"))
    return outcomes.link_map(mains, _told(spark, sf_dir, links))


@query(f"WITH {_MAP} SELECT * FROM lm")
def link_map(spark, sf_dir):
    return _map(spark, sf_dir).select("bundle_id", "key", "relative_path")


@query(f"""WITH {_MAP},
hits AS (SELECT r.bundle_id, r.pos, l.relative_path FROM ref r JOIN lm l ON l.bundle_id = r.bundle_id AND l.key = r.link_url),
firsts AS (SELECT bundle_id, relative_path, min(pos) AS pos FROM hits GROUP BY ALL),
titles AS (SELECT bundle_id, relative_path, min(title) AS title FROM told WHERE kind <> 'alias' GROUP BY ALL)
SELECT bundle_id, '## Direct References' || chr(10) || chr(10) || string_agg('- [' || title || '](' || relative_path || ')', chr(10) ORDER BY pos) AS section FROM firsts JOIN titles USING (bundle_id, relative_path) GROUP BY bundle_id""")
def reference_section(spark, sf_dir):
    links = _links(spark, sf_dir)
    found = links.select(F.col("page_id").alias("bundle_id"), "pos", "link_url")
    return outcomes.reference_sections(found, _map(spark, sf_dir, links))


@query(f"""WITH {_OUTCOMES},
entry AS (SELECT bundle_id, pos, '"' || relative_path || '":' || CASE WHEN failed THEN '{{"original_url":"' || link_url || '","title":"' || title || '","content_type":"","kind":"failed","fail_reason":"No response for ' || link_url || '"'
  ELSE '{{"original_url":"' || link_url || '","title":"' || title || '","content_type":"' || CASE WHEN t % 6 = 0 THEN 'application/pdf' ELSE 'text/html' END || '","kind":"' || CASE WHEN t % 6 = 0 THEN 'asset' ELSE 'html' END || '"'
  || CASE WHEN final_url <> link_url THEN ',"final_url":"' || final_url || '"' ELSE '' END || CASE WHEN t % 6 = 0 THEN ',"asset_path":"' || replace(replace(relative_path, 'references/', 'references/assets/'), '.md', '.pdf') || '"' ELSE '' END END
  || coalesce(',"additional_original_urls":["' || (SELECT a.link_url FROM told a WHERE a.bundle_id = o.bundle_id AND a.kind = 'alias' AND a.relative_path = o.relative_path) || '"]', '') || '}}' AS e FROM told o WHERE kind <> 'alias')
SELECT bundle_id, '{{' || string_agg(e, ',' ORDER BY pos) || '}}' AS json FROM entry GROUP BY bundle_id""")
def manifest(spark, sf_dir):
    mains = linked(spark, sf_dir).select(F.col("page_id").alias("bundle_id"))
    return outcomes.manifests(_told(spark, sf_dir), mains)


@query("""
WITH r AS (SELECT page_id % 40 AS bundle_id, CAST(page_id // 40 AS INT) AS pos, 'Title ' || page_id % 3 AS title FROM pages)
SELECT bundle_id, pos, 'references/title-' || right(title, 1) || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS relative_path FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, title ORDER BY pos) AS k FROM r)""")
def reference_names(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("bundle_id"), F.floor(F.col("page_id") / 40).cast("int").alias("pos"), F.concat(F.lit("Title "), (F.col("page_id") % 3).cast("string")).alias("title"))
    return outcomes.allocate_names(p)


#: Pictures in each page: a figure, the same again, a logo and a formula.
@query("""SELECT page_id, CAST(k AS INT) AS pos, 'https://site.example.org/img/figure-' || page_id % 7 || '.png' AS image_url, CASE k WHEN 0 THEN 'Figure & ' || page_id % 7 ELSE '' END AS alt FROM pages, (VALUES (0), (1)) t(k)""")
def image_candidates(spark, sf_dir):
    n = (F.col("page_id") % 7).cast("string")
    html = F.concat(
        F.lit('<p><img class="x" src="/img/figure-'), n, F.lit('.png" alt="Figure &amp; '), n, F.lit('"><img src="https://site.example.org/img/figure-'), n, F.lit('.png"><img src="/a/site-logo.png" alt="x"><img src="/b.png" alt="Our logo"><img src="/math/f.png"></p>'),
    )
    p = read(spark, sf_dir, "pages").select("page_id", F.lit("https://site.example.org/p/1").alias("url"), html.alias("html"))
    return extract.images(p, ["page_id"])


@query("""
WITH i AS (SELECT page_id, k, 'https://cdn.example.org/' || (page_id * 5 + k) || '.png' AS image_url, (page_id * 5 + k) % 6 AS c FROM pages, (VALUES (0), (1), (2), (3), (4)) t(k)),
o AS (SELECT *, CASE c WHEN 1 THEN 'failed' WHEN 2 THEN 'dropped' WHEN 3 THEN 'dropped' WHEN 4 THEN 'dropped' ELSE 'localized' END AS kind, CASE c WHEN 2 THEN 'not_image' WHEN 3 THEN 'too_small_bytes' WHEN 4 THEN 'tiny_dimensions' END AS reason FROM i)
SELECT page_id AS bundle_id, CAST(k AS INT) AS pos, image_url, kind, reason, CASE WHEN kind = 'localized' THEN 'assets/' || lpad(CAST(sum(CASE WHEN kind = 'localized' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS VARCHAR), 2, '0') || '-shown-' || k || '.png' END AS relative_path FROM o""")
def asset_outcomes(spark, sf_dir):
    k = F.explode(F.array(*map(F.lit, range(5)))).alias("k")
    number = F.col("page_id") * 5 + F.col("k")
    i = read(spark, sf_dir, "pages").select("page_id", k).select(F.col("page_id").alias("bundle_id"), F.lit("index.md").alias("page_path"), F.col("k").alias("pos"), F.concat(F.lit("https://cdn.example.org/"), number.cast("string"), F.lit(".png")).alias("image_url"), F.concat(F.lit("Shown "), F.col("k").cast("string")).alias("alt"), (number % 6).alias("c"))
    large, small = "89504E470D0A1A0A0000000D49484452000000780000005A" + "00" * 600, "89504E470D0A1A0A0000000D49484452000000100000000A" + "00" * 600
    body = F.when(F.col("c") == 2, F.unhex(F.lit("68656C6C6F20776F726C642E"))).when(F.col("c") == 3, F.unhex(F.lit(large[:200]))).when(F.col("c") == 4, F.unhex(F.lit(small))).otherwise(F.unhex(F.lit(large)))
    fetched = i.where("c <> 1").select("image_url", body.alias("body"), F.lit("image/png").alias("content_type"), F.lit(None).cast("string").alias("fail_reason"))
    return assets.outcomes(i.drop("c"), fetched).select("bundle_id", "pos", "image_url", "kind", "reason", "relative_path")


_PHRASES = [(2, "Get started today."), (3, "Trusted by teams."), (5, "Free for all, then pro."), (7, "Our newsletter.")]
_MIX = "'<main><p>x</p>' || " + " || ".join(f"CASE WHEN page_id % {n} = 0 THEN '<p>{p}</p>' ELSE '' END" for n, p in _PHRASES) + " || '</main>'"
_SIGNS = "list_filter([CASE WHEN page_id % 2 = 0 THEN 'cta' END, CASE WHEN page_id % 3 = 0 THEN 'social-proof' END, CASE WHEN page_id % 5 = 0 THEN 'pricing' END, CASE WHEN page_id % 7 = 0 THEN 'form' END], lambda x: x IS NOT NULL)"


@query(
    f"SELECT page_id, array_to_string({_SIGNS}, ',') AS signals, NOT ({_SAME}) AND NOT ({_LIKE.format('ref_url')}) AND ({_TRIMMED.format('ref_url')} IN ('/', '/home') OR {_LANDING.format('ref_url')}) AND len({_SIGNS}) >= 2 AS skipped FROM ({_POLICY})"
)
def marketing_signals(spark, sf_dir):
    html = F.concat(F.lit("<main><p>x</p>"), *[F.when(F.col("page_id") % n == 0, F.lit(f"<p>{p}</p>")).otherwise(F.lit("")) for n, p in _PHRASES], F.lit("</main>"))
    p = _policy(spark, sf_dir).withColumn("main_html", html)
    p = p.withColumn("found", outcomes.marketing_signals("main_html", "main_html")).withColumn("n", F.size("found"))
    return p.select("page_id", F.array_join("found", ",").alias("signals"), outcomes.low_signal("main_url", "ref_url", "n").alias("skipped"))


_NOTE = "'# Turn ' || turn || chr(10) || chr(10) || '<Note>' || chr(10) || text || chr(10) || '</Note>'"


@query(f"""SELECT conv_id, turn, '# Turn ' || turn || chr(10) || chr(10) || 'Source: https://example.org/c/' || conv_id || '/' || turn || '.md' || chr(10) || 'Content-Type: text/markdown' || chr(10) || chr(10)
  || regexp_replace(regexp_replace(ltrim(chr(10) || text || chr(10), chr(10)), '^', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS markdown FROM (SELECT conv_id, turn, replace(replace(text, '<', '('), '`', ' ') AS text FROM conversations)""")
def text_entries(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("<"), F.lit("(")), F.lit("`"), F.lit(" "))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("text"))
    url = F.concat(F.lit("https://example.org/c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md"))
    body = F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n\n<Note>\n"), "text", F.lit("\n</Note>"))
    c = c.withColumn("url", url).withColumn("body", body).withColumn("title", F.coalesce(T.markdown_title("body"), U.title_from_url("url")))
    head = render.header("title", "url", "url", "url", F.lit("text/markdown"))
    return c.select("conv_id", "turn", render.text_entry(head, "body", "title", F.lit("markdown"), F.lit("markdown"), F.lit("direct"), T.slug).alias("markdown"))


@query("""SELECT conv_id, turn, repeat('`', greatest(2, coalesce(list_max(list_transform(regexp_extract_all(b, '`+'), lambda x: length(x))), 0)) + 1) AS fence, 'text' AS language,
  coalesce(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '')[1], '') AS first_line FROM (SELECT conv_id, turn, chr(10) || repeat('`', CAST(turn % 6 AS INT)) || ' ' || text AS b FROM conversations)""")
def fenced_entries(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("b", F.concat(F.lit("\n"), F.expr("repeat('`', cast(turn % 6 as int))"), F.lit(" "), "text"))
    return c.select("conv_id", "turn", T.fence("b").alias("fence"), F.lit("text").alias("language"), T.first_line("b").alias("first_line"))


@query(f"SELECT page_id, coalesce(nullif({_SLUG.format('t')}, ''), 'page') AS slug, regexp_replace(left(coalesce(nullif({_SLUG.format('t')}, ''), 'page'), 20), '-+$', '') AS short FROM (SELECT page_id, strip_accents({_TITLE}) AS t FROM pages)")
def slugs(spark, sf_dir):
    """Titles have accents only, so removing them is all that decomposition does here."""
    p = pages(spark, sf_dir).select("page_id", extract.title("html").alias("t")).withColumn("slug", T.slug_any("t"))
    return p.select("page_id", "slug", T.truncate("slug", 20).alias("short"))


@query("""SELECT page_id, '# ' || page_id || chr(10) || chr(10) || 'Source: ' || url || CASE WHEN starts_with(url, 'http:') THEN chr(10) || 'Fetched URL: ' || replace(url, 'http:', 'https:') ELSE '' END
  || CASE WHEN contains(url, '#') THEN chr(10) || 'Final URL: ' || regexp_replace(replace(url, 'http:', 'https:'), '#.*', '') ELSE '' END || chr(10) || 'Content-Type: text/html' AS header,
  '# ' || page_id || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || 'Failed to download this source.' || chr(10) || chr(10) || 'Reason: HTTP 404' || chr(10) AS stub,
  'h' || chr(10) || chr(10) || 'Original source asset: [assets/a.pdf](assets/a.pdf)' || chr(10) || chr(10) || 'Text extraction is deferred to a specialized pipeline.' || chr(10) AS asset FROM pages""")
def provenance(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("t", F.col("page_id").cast("string")).withColumn("f", U.upgraded("url")).withColumn("e", U.document_key("f"))
    return p.select(
        "page_id", render.header("t", "url", "f", "e", F.lit("text/html")).alias("header"), render.failure_stub("t", "url", F.lit("HTTP 404")).alias("stub"),
        render.asset_entry(F.lit("h"), F.lit("references/assets/a.pdf"), F.lit("references/a.md")).alias("asset"),
    )


_TIDY = "'> see llms.txt' || chr(10) || '> more' || chr(10) || chr(10) || '# Item ' || item_id || chr(10) || chr(10) || '<Card title=\"x\">' || t || '</Card><Frame />' || chr(10) || chr(10) || chr(10) || chr(10) || 'end theme={null}'"


@query("""SELECT item_id, t || chr(10) || chr(10) || 'end' AS tidied, 'a  [b](x.md)' || chr(10) || chr(10) || 'c ![](i.png)' AS converted, 'references/assets/n' AS folder FROM (SELECT item_id, trim(replace(replace(text, '<', '('), chr(10), ' ')) AS t FROM benchmark)""")
def markdown_tidy(spark, sf_dir):
    t = F.trim(F.replace(F.replace("text", F.lit("<"), F.lit("(")), F.lit("\n"), F.lit(" ")))
    body = F.concat(F.lit("> see llms.txt\n> more\n\n# Item "), F.col("item_id").cast("string"), F.lit('\n\n<Card title="x">'), t, F.lit("</Card><Frame />\n\n\n\nend theme={null}"))
    b = read(spark, sf_dir, "benchmark").select("item_id", body.alias("b"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"))
    converted = T.tidy_converted(F.lit("a [](y) [b](x.md)\n\n\nc ![](i.png)[ ](z)\n"), F.lit("self.md"))
    return b.select("item_id", T.tidy_markdown("b", "title", T.slug).alias("tidied"), converted.alias("converted"), T.asset_dir(F.lit("references/n.md")).alias("folder"))


@query()
def page_markdown(spark, sf_dir):
    """Markdown of every page; the converter has no SQL form for any markup, so tests check it on fixed pages."""
    p = extract.parse(pages(spark, sf_dir))
    return p.select("page_id", "title", render.html_body(extract.clean("main_html")).alias("markdown"))


#: A page of each kind of markup, with its number in it.
_RICH = (
    '<script>no()</script><h1 class="t">Page {n}</h1><p style="x">Intro <strong>bold {n}</strong>, <em>soft</em>.</p><h2>Part {n}</h2><ul><li>one</li><li>two {n}</li></ul><ol><li>first</li><li>second</li></ol>'
    "<table><tr><th>k</th><th>v</th></tr><tr><td><ul><li>a</li><li>b</li></ul></td><td>{n}</td></tr></table>"
    '<p><a href="/ref/{n}">the reference</a>, <a href="/far#x">far</a>, <a href="mailto:a@b.c">mail</a> and <a href="#top">top</a>.</p>'
    '<p><img class="i" src="/pics/fig.png" alt="Fig"> and <img src="/logo.png" alt="Site logo"><img src="/pics/gone.png" alt="gone">.</p>'
    '<pre><code class="language-py">x = {n}</code></pre><blockquote><p>said {n}</p></blockquote><p>Use <code>f({n})</code>.</p><hr><p>a<br>b</p>'
)
_RICH_MD = (
    "# Page {n}\n\nSource: https://site.example.org/p/{n}\nContent-Type: text/html\n\n## Direct References\n\n- [Ref](references/ref-{n}.md)\n\n"
    "Intro **bold {n}**, _soft_.\n\n## Part {n}\n\n-   one\n-   two {n}\n\n1.  first\n2.  second\n\n"
    "| k | v |\n| --- | --- |\n| a<br>b | {n} |\n\n"
    "[the reference](references/ref-{n}.md), [far](https://site.example.org/far#x), [mail](mailto:a@b.c) and [top](#top).\n\n"
    "![Fig](assets/01-fig.png) and .\n\n"
    "```\nx = {n}\n```\n\n> said {n}\n\nUse `f({n})`.\n\n* * *\n\na  \nb\n"
)


def _spelled(template: str) -> str:
    """SQL for a template with page_id in the place of {n}."""
    quoted = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return quoted.replace("{n}", "' || page_id || '")


@query(f"SELECT page_id AS bundle_id, 'index.md' AS relative_path, {_spelled(_RICH_MD)} AS markdown FROM pages")
def render_html(spark, sf_dir):
    """Pages of every kind of markup through the whole operator: links, images, sections and Markdown."""
    n = F.col("page_id").cast("string")
    filled = lambda template: F.replace(F.lit(template), F.lit("{n}"), n)
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("bundle_id"), n.alias("n"), filled("https://site.example.org/p/{n}").alias("url"), filled(_RICH).alias("main_html"), filled("Page {n}").alias("title"), filled("references/ref-{n}.md").alias("ref"), filled("https://site.example.org/ref/{n}").alias("key"))
    mains = p.select("bundle_id", F.lit("index.md").alias("relative_path"), F.col("url").alias("page_url"), "title", F.col("url").alias("requested_url"), F.col("url").alias("fetched_url"), F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), "main_html")
    links_to = p.select("bundle_id", "key", F.col("ref").alias("relative_path"), F.lit("Ref").alias("title"))
    picture = lambda name, kind, path: F.struct(F.lit(f"https://site.example.org/pics/{name}.png").alias("image_url"), F.lit(kind).alias("kind"), F.lit(path).cast("string").alias("relative_path"))
    shown = p.select("bundle_id", F.lit("index.md").alias("page_path"), F.explode(F.array(picture("fig", "localized", "assets/01-fig.png"), picture("gone", "dropped", None))).alias("i")).select("bundle_id", "page_path", "i.*")
    sections = p.select("bundle_id", F.concat(F.lit("## Direct References\n\n- [Ref]("), "ref", F.lit(")")).alias("section"))
    return render.render_html(mains, links_to, shown, sections)




_OWN_LINK = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%3A', ':')"


#: Each anchor of a page as pos, label and link_url.
_ANCHORS = f"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1) AS hs, regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2) AS ts FROM pages),
e AS (SELECT page_id, url, hs[k] AS href, nullif({_tags('ts[k]')}, '') AS label, k - 1 AS pos FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM a)),
l AS (SELECT page_id, pos, label, {_OWN_LINK} AS link_url FROM e)"""


@query(f"""{_ANCHORS}
SELECT page_id, CAST(min(pos) AS INT) AS pos, link_url, arg_min(label, pos) FILTER (WHERE label IS NOT NULL) AS link_label, link_url AS doc_key FROM l GROUP BY page_id, link_url""")
def page_links(spark, sf_dir):
    """The links of whole pages, one for each document, with the first label that says something."""
    return extract.links(pages(spark, sf_dir), ["page_id"])


#: What each site puts into the pages' own HTML, and what its rule leaves of them.
_BEFORE = ['<div class="subheader">a<div>b</div></div>', '<div class="mw-content-ltr mw-parser-output"><div class="reflist">x<div>y</div></div>', "", '<button type="button">b</button>']
_AFTER = [
    "<h3>References &amp; Citations</h3><p>cut</p>", '<div class="mw-heading mw-heading2"><h2 id="References">R</h2></div><p>cut</p></div> <noscript>n</noscript>', "",
    "<p> or import from </p><h2>Ready to build something amazing?</h2><p>cut</p>",
]
_OPENS = [f"<article>{_BEFORE[0]}", f"<article>{_BEFORE[1]}", '<article class="markdown-body entry">', f"<article>{_BEFORE[3]}"]
_WITHIN = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_HEAD = "regexp_extract(html, '(?s)^(.*?)<article>', 1)"
_H2 = "regexp_replace({0}, '(?s)<h1>(.*?)</h1>', '<h2>\\1</h2>')"


@query(
    f"""SELECT page_id, md5(CASE page_id % 5 WHEN 0 THEN {_HEAD} || '<article>' || {_WITHIN} WHEN 1 THEN {_WITHIN} WHEN 2 THEN '<main><article><article class="markdown-body entry">' || {_WITHIN} || '</article></article></main>'
    WHEN 3 THEN {_H2.format(f"{_HEAD} || '<article>' || {_WITHIN}")} || '</body></html>' ELSE html END) AS cleaned_md5 FROM pages WHERE {_WITHIN} <> ''"""
)
def site_pages(spark, sf_dir):
    """The pages' own HTML as four sites would show it, cleaned by the rules of these; every fifth page has no rule."""
    at = (F.col("page_id") % 5 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, [*values, ""])), at)
    p = pages(spark, sf_dir).where(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1) != "")
    shown = F.concat(
        F.regexp_extract("html", "(?s)^(.*?)<article>", 1), pick([*_OPENS, ""]), F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), pick(_AFTER), F.regexp_extract("html", "(?s)<article>.*?(</article>.*)$", 1)
    )
    url = F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, [*_SITES, "example.com"])), at), F.lit("/x"))
    p = p.select("page_id", F.when(F.col("page_id") % 5 == 4, F.col("html")).otherwise(shown).alias("html"), url.alias("url"))
    return p.select("page_id", F.md5(chrome.with_site_rules("html", "url")).alias("cleaned_md5"))


_SAID = "html || " + " || ".join(f"CASE WHEN page_id % {n} = 0 THEN '<p>{p}</p>' ELSE '' END" for n, p in _PHRASES)
_STRIPPED = "lower(regexp_replace(said, '<[^>]+>', ' ', 'g'))"
_TESTS = {
    "cta": f"regexp_matches({_STRIPPED}, '\\b({outcomes.SIGNALS['cta']})\\b')", "social-proof": f"regexp_matches({_STRIPPED}, '\\b({outcomes.SIGNALS['social-proof']})\\b')",
    "pricing": f"regexp_matches({_STRIPPED}, '(?s)\\bpricing\\b|\\bfree\\b.{{0,80}}\\b(pro|enterprise)\\b')", "form": f"regexp_matches(said, '(?i)<form\\b') OR regexp_matches({_STRIPPED}, '\\bnewsletter\\b')",
}


@query(f"SELECT page_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {t} THEN {n!r} END' for n, t in _TESTS.items())}], lambda x: x IS NOT NULL), ',') AS signals, CAST(length(said) AS BIGINT) AS n_chars FROM (SELECT page_id, {_SAID} AS said FROM pages)")
def page_signals(spark, sf_dir):
    """Marketing phrases looked for in whole pages, some of which say them at their end."""
    said = F.concat("html", *[F.when(F.col("page_id") % n == 0, F.lit(f"<p>{p}</p>")).otherwise(F.lit("")) for n, p in _PHRASES])
    p = pages(spark, sf_dir).select("page_id", said.alias("said"))
    return p.select("page_id", F.array_join(outcomes.marketing_signals("said", F.lit("")), ",").alias("signals"), F.length("said").cast("long").alias("n_chars"))


@query(f"""
SELECT page_id, CAST(k AS INT) AS pos, CASE k WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/img/figure-' || page_id % 7 || '.png' ELSE 'https://cdn.example.org/p/' || page_id || '.jpg' END AS image_url,
CASE k WHEN 0 THEN 'Figure & ' || page_id % 7 ELSE '' END AS alt FROM pages, (VALUES (0), (2)) t(k) WHERE regexp_matches(html, '(?s)<article>.*?</article>')""")
def page_images(spark, sf_dir):
    """Pictures within the pages' own articles: a figure, a logo, one behind an image optimizer, a formula; furniture has one too."""
    n = F.col("page_id").cast("string")
    shown = F.concat(
        F.lit('<p><img class="x" src="/img/figure-'), (F.col("page_id") % 7).cast("string"), F.lit('.png" alt="Figure &amp; '), (F.col("page_id") % 7).cast("string"), F.lit('"><img src="/a/site-logo.png"><img src="/_next/image?url=https%3A%2F%2Fcdn.example.org%2Fp%2F'), n,
        F.lit('.jpg&amp;w=640"><img src="/math/f.png"></p></article><footer><img src="/footer.png"></footer>'),
    )
    p = pages(spark, sf_dir).where(F.col("html").rlike("(?s)<article>.*?</article>"))
    p = p.select("page_id", "url", F.concat(F.regexp_extract("html", "(?s)^(.*?)</article>", 1), shown, F.regexp_extract("html", "(?s)^.*?</article>(.*)$", 1)).alias("html"))
    return extract.images(extract.parse(p), ["page_id"], "article_html", "url")


@query(ORACLES["strip_chrome"])
def strip_chrome_rows(spark, sf_dir):
    """As strip_chrome, by tags as rows."""
    return balance.without_by_table(pages(spark, sf_dir), ["page_id"]).select("page_id", F.md5("html").alias("html_md5"))


@query(f"""{_ANCHORS}
SELECT page_id, link_url, 'reference-' || lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS VARCHAR), 3, '0') || '.source' AS source_name FROM l GROUP BY page_id, link_url""")
def source_names(spark, sf_dir):
    """Under what names the responses to the links of whole pages are kept."""
    found = extract.links(pages(spark, sf_dir), ["page_id"])
    return found.select("page_id", "link_url", names.source_name(F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).alias("source_name"))
