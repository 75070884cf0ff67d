"""Column functions over text, HTML fragments and Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions import web
from folioforge.functions.arrow import python_udf

#: White space of HTML authors' scripts: more than Java's \s.
SPACE = r"[\s\x0B\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Wrapper tags of component Markdown.
MDX_TAGS = "CodeGroup CardGroup Card Columns Column Tabs Tab TabItem Steps Step Note Tip Warning Info Callout Accordion AccordionGroup Frame Tooltip ParamField ResponseField Expandable".split()


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value) with value computed once: keeps expressions that use it often small."""
    return F.transform(F.array(value), use)[0]


def trim(x) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")


def trim_start(x) -> Column:
    return F.regexp_replace(col(x), rf"\A{SPACE}+", "")


@python_udf(StringType())
def _decode_all(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else web.decode_entities(t) for t in text], dtype=object)


@python_udf(StringType())
def _unmarked(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else web.unmarked(t) for t in text], dtype=object)


def decode_entities(x) -> Column:
    """The fixed entities inside the JVM. Numeric ones go through ``decode_numeric`` beforehand, where they occur."""
    out = col(x)
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, "(?i)&#x27;", "'"), "(?i)&#x2f;", "/")


def decode_html(x) -> Column:
    """All entities that are known, numeric ones too; null for a code point out of range."""
    return _decode_all(col(x))


def strip_tags(x, *, numeric: bool = False) -> Column:
    """Tags become spaces, runs of space one, ends are trimmed; entities are decoded last."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(col(x), "<[^>]+>", " "), SPACE + "+", " "))
    return decode_html(plain) if numeric else decode_entities(plain)


def first_line(x) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), trim), lambda line: line != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def _slug(plain: Column, fallback) -> Column:
    out = F.replace(F.regexp_replace(plain, "['’]", ""), F.lit("&"), F.lit(" and "))
    out = F.lower(F.regexp_replace(F.regexp_replace(out, "[^a-zA-Z0-9]+", "-"), r"^-+|-+\z", ""))
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(out == "", fallback).otherwise(out)


def slug(x, fallback="page") -> Column:
    """A name for files, of text in ASCII. ``slug_any`` also decomposes accents."""
    return _slug(decode_entities(x), fallback)


def slug_any(x, fallback="page") -> Column:
    return _slug(_unmarked(decode_html(x)), fallback)


def truncate(x, longest: int = 80) -> Column:
    cut = F.substring(col(x), 1, longest)
    bare = F.regexp_replace(cut, r"-+\z", "")
    return F.when(F.length(col(x)) <= longest, col(x)).when(bare == "", cut).otherwise(bare)


def closing_newline(x) -> Column:
    return F.when(F.endswith(col(x), F.lit("\n")), col(x)).otherwise(F.concat(col(x), F.lit("\n")))


def fence(x) -> Column:
    """One backtick more than the longest run in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(col(x), F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1)


def markdown_title(x) -> Column:
    """The first heading of level one; null if there is none."""
    found = trim(F.regexp_extract(col(x), r"(?m)^#\s+(.+?)\s*$", 1))
    return F.when(found != "", found)


def strip_preamble(x) -> Column:
    """Drop a leading quote block that points to a documentation index."""
    body = col(x)
    trimmed = trim_start(body)
    block = F.regexp_extract(trimmed, r"\A((?:>[^\n]*(?:\n|\z))+)", 1)
    rest = F.regexp_replace(F.substring(trimmed, F.length(block) + 1, F.length(trimmed)), rf"\A(?:(?!\n){SPACE}*(?:\n|\z))+", "")
    return F.when((block != "") & block.rlike(r"(?i)documentation index|llms\.txt"), rest).otherwise(body)


def strip_title(x, title, make=slug) -> Column:
    """Drop a leading heading that says the title again."""
    body = col(x)
    trimmed = trim_start(body)
    heading = rf"\A#{SPACE}+([^\n]+?){SPACE}*(?:\n|\z)"
    rest = trim_start(F.regexp_replace(trimmed, heading, ""))
    return F.when(trimmed.rlike(heading) & (make(F.regexp_extract(trimmed, heading, 1)) == make(title)), rest).otherwise(body)


def strip_mdx(x) -> Column:
    """Drop component tags, keeping what they wrap."""
    out = col(x)
    for tag in MDX_TAGS:
        out = F.regexp_replace(out, rf"<{tag}\b[^>]*?/>", "")
        out = F.regexp_replace(out, rf"</?{tag}\b[^>]*?>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"</?div\b[^>]*>", ""), r"[ \t]+theme=\{null\}", "")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def tidy_markdown(x, title, make=slug) -> Column:
    return strip_mdx(strip_title(strip_preamble(x), title, make))


def tidy_converted(x, self_name=None) -> Column:
    """Drop empty links, unwrap links to the page itself, close gaps."""
    out = F.regexp_replace(col(x), r"(?<!!)\[\s*\]\([^)]*\)", "")
    if self_name is not None:
        out = F.regexp_replace(out, F.concat(F.lit(r"\[([^\]]*)\]\(\.?/?\Q"), col(self_name), F.lit(r"\E(?:#[^)]*)?\)")), F.lit("$1"))
    return trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def asset_dir(markdown_path) -> Column:
    p = col(markdown_path)
    base, folder = F.regexp_extract(p, r"([^/]*?)(\.md)?\z", 1), F.regexp_extract(p, r"\A(.*/)[^/]*\z", 1)
    return F.concat(folder, F.when(base == "index", F.lit("assets")).otherwise(F.concat(F.lit("assets/"), base)))


def relative_path(origin, target) -> Column:
    """Of bundle paths: the origin is at the top or in one folder."""
    folder = F.regexp_extract(col(origin), r"\A(.*/)[^/]*\z", 1)
    ups = F.repeat(F.lit("../"), F.size(F.split(folder, "/")) - 1)
    return F.when(folder == "", col(target)).when(F.startswith(col(target), folder), F.substring(col(target), F.length(folder) + 1, F.length(col(target)))).otherwise(F.concat(ups, col(target)))
