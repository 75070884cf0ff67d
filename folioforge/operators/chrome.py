"""Removal of page furniture: balanced elements by tag and attribute, and rules for single sites."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioforge.functions.arrow import python_udf
from folioforge.functions.text import col
from folioforge.functions.urls import raw_host
from folioforge.session import small_batches

#: Elements that one test removes at most; what is left after so many stays.
MOST = 1000


@dataclass(frozen=True)
class Element:
    """Elements of a tag: all, those whose attribute finds a pattern, or those whose role is one of some words."""

    tag: str
    attribute: str | None = None
    pattern: str = ""
    words: frozenset[str] = frozenset()

    def fits(self, attrs: str) -> bool:
        if self.attribute is None:
            return True
        value = attribute(attrs, self.attribute) or ""
        if self.words:
            return not self.words.isdisjoint(value.lower().split())
        return bool(value and re.search(self.pattern, value, re.IGNORECASE | re.ASCII))


def attribute(attrs: str, name: str) -> str | None:
    """The value of the first attribute of that name, in quotes of either kind, or else bare."""
    for form, group in ((rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", None), (rf"\b{name}\s*=\s*([^\s>]+)", 1)):
        if m := re.search(form, attrs, re.IGNORECASE | re.ASCII | re.DOTALL):
            return m[group] if group else m[1] if m[1] is not None else m[2]
    return None


def _tags(html: str, names: set[str]) -> dict[str, list[tuple[int, int, str | None]]]:
    """By name, the tags of that name in order: start, end, and the attributes, or None for closing tags."""
    found: dict[str, list[tuple[int, int, str | None]]] = {n: [] for n in names}
    for name, tags in found.items():
        for m in re.finditer(rf"<(/?){name}\b([^>]*)>", html, re.IGNORECASE | re.ASCII):
            tags.append((m.start(), m.end(), None if m[1] else m[2]))
    return found


def without(html: str, elements: tuple[Element, ...]) -> str:
    """Cut elements with all they hold, one kind after the other, in one reading of the tags.

    An element ends where as many tags of its name have closed as opened. Of
    each kind the first that never closes ends the cutting, so later ones
    stay. Tags count as they stand in html: what a cut would join is no tag.
    """
    tags = _tags(html, {e.tag for e in elements})
    cuts: list[tuple[int, int]] = []
    for element in elements:
        firsts = [a for a, _ in cuts]
        own = [t for t in tags[element.tag] if not (k := bisect_right(firsts, t[0])) or cuts[k - 1][1] <= t[0]]
        ends, opened = {}, []
        for start, end, attrs in own:
            if attrs is not None:
                opened.append(start)
            elif opened:
                ends[opened.pop()] = end
        new, upto = [], -1
        for start, _, attrs in own:
            if start < upto or attrs is None or not element.fits(attrs):
                continue
            if start not in ends or len(new) == MOST:
                break
            upto = ends[start]
            new.append((start, upto))
        cuts = _united(cuts + new)
    at, out = 0, []
    for a, b in cuts:
        out.append(html[at:a])
        at = b
    return "".join([*out, html[at:]])


def _united(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(cuts):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _roles(tag: str, *words: str) -> Element:
    return Element(tag, "role", words=frozenset(words))


#: Elements dropped from every page. Fixed values.
FURNITURE = (
    Element("nav"), Element("header"), Element("footer"), Element("aside"),
    _roles("div", "navigation", "complementary", "banner", "contentinfo", "search"),
    _roles("section", "navigation", "complementary"),
)


def strip_furniture(html: str) -> str:
    return re.sub(r"(?i)\[\s*edit\s*\]", "", without(html, FURNITURE))


# What a site rule may do, step by step. Patterns ignore case; a dot is any character.


@dataclass(frozen=True)
class Drop:
    """Cut whole elements."""

    elements: tuple[Element, ...]


@dataclass(frozen=True)
class Erase:
    """Cut what the patterns match, each in turn; or put something else in the place of the first match."""

    patterns: tuple[str, ...]
    by: str = ""
    count: int = 0


@dataclass(frozen=True)
class Keep:
    """Keep a group of the first pattern that matches, inside a frame; without a match all stays."""

    patterns: tuple[str, ...]
    group: int
    frame: tuple[str, str] = ("", "")


@dataclass(frozen=True)
class Stop:
    """Keep what stands before the earliest match, and put an end to it; without a match all stays."""

    patterns: tuple[str, ...]
    end: str = ""


Step = Drop | Erase | Keep | Stop | Callable[[str], str]


@dataclass(frozen=True)
class SiteRule:
    """How to clean the pages of hosts that a pattern finds."""

    name: str
    hosts: str
    steps: tuple[Step, ...]


def _marked(tag: str, name: str, *values: str) -> tuple[Element, ...]:
    return tuple(Element(tag, name, rf"\b{v}\b") for v in values)


def _whole(tag: str, word: str, inside: str = ".*?") -> str:
    return rf'<{tag}\b[^>]*class="[^"]*\b{word}\b[^"]*"[^>]*>{inside}</{tag}>'


_ARTICLE = r'<div class="mw-content-ltr mw-parser-output"[^>]*>(.*?)</div>\s*(?:<noscript|<div class="printfooter"|<div id="catlinks")'

#: In this order; all that match apply. The sites, their classes, ids and headings are fixed values.
SITE_RULES: list[SiteRule] = [
    SiteRule(
        "arxiv", r"(^|\.)arxiv\.org$",
        (
            Drop(_marked("div", "class", "subheader", "header-breadcrumbs-mobile", "browse", "extra-ref-cite")),
            Erase((_whole("a", "mobile-submission-download"),)),
            Stop((r"<h3>\s*References\s*&(?:amp;)?\s*Citations\s*</h3>",)),
            Stop((r"""<div\b[^>]*(?:id\s*=\s*['"](?:bib-cite-modal|labstabs)['"]|class\s*=\s*['"]bookmarks['"])""",)),
        ),
    ),
    SiteRule(
        "wikipedia", r"(^|\.)wikipedia\.org$",
        (
            Keep((r'<div id="mw-content-text"[^>]*>.*?' + _ARTICLE, _ARTICLE), 1),
            Drop((*_marked("div", "class", "reflist", "navbox"), *_marked("div", "id", "catlinks"), *_marked("span", "class", "mw-editsection"), *_marked("table", "class", "navbox"))),
            Erase((_whole("div", "shortdescription"), _whole("div", "mw-subjectpageheader"), _whole("p", "mw-empty-elt", r"\s*"), r'<meta\b[^>]*property="mw:PageProp/toc"[^>]*>')),
            Stop((r'<div\b[^>]*class="[^"]*\bmw-heading\b[^"]*"[^>]*>\s*<h2\b[^>]*id="(?:References|External_links)"',)),
        ),
    ),
    SiteRule(
        "github", r"(^|\.)github\.com$",
        (Keep((r'<article\b[^>]*class="[^"]*markdown-body[^"]*"[^>]*>.*?</article>',), 0, ("<main><article>", "</article></main>")),),
    ),
    SiteRule(
        "bolt", r"(^|\.)(?:bolt|blot)\.new$",
        (
            Erase((r"<h1\b([^>]*)>",), r"<h2\1>", 1),
            Erase((r"</h1>",), "</h2>", 1),
            Drop((Element("button"), Element("input"))),
            Erase((r"<p\b[^>]*>\s*or\s+import\s+from\s*</p>",)),
            Stop(
                (
                    r"<h2\b[^>]*>\s*Your\s+company(?:'|’|&#x27;|&apos;)?s\s+design\s+system,\s+now\s+in\s+Bolt",
                    r"<h2\b[^>]*>\s*The\s+#?1\s+professional\s+vibe\s+coding\s+tool",
                    r"<h2\b[^>]*>\s*Ready\s+to\s+build\s+something\s+amazing\?",
                ),
                "</body></html>",
            ),
        ),
    ),
]


def apply_step(html: str, step: Step) -> str:
    flags = re.IGNORECASE | re.ASCII | re.DOTALL
    match step:
        case Drop(elements):
            return without(html, elements)
        case Erase(patterns, by, count):
            for p in patterns:
                html = re.sub(p, by, html, count=count, flags=flags)
            return html
        case Keep(patterns, group, (head, tail)):
            found = next((m for p in patterns if (m := re.search(p, html, flags))), None)
            return f"{head}{found[group]}{tail}" if found else html
        case Stop(patterns, end):
            starts = [m.start() for p in patterns if (m := re.search(p, html, flags))]
            return html[: min(starts)] + end if starts else html
    return step(html)


def register_site_rule(rule: SiteRule) -> None:
    """Add a rule after the others, or replace the one of its name."""
    for i, own in enumerate(SITE_RULES):
        if own.name == rule.name:
            SITE_RULES[i] = rule
            return
    SITE_RULES.append(rule)


def apply_site_rules(html: str, host: str) -> str:
    for rule in SITE_RULES:
        if re.search(rule.hosts, host or "", re.IGNORECASE):
            for step in rule.steps:
                html = apply_step(html, step)
    return html


@python_udf(StringType())
def without_furniture(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else strip_furniture(h) for h in html], dtype=object)


@python_udf(StringType())
def _site_rules(html: pd.Series, host: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else apply_site_rules(h, n) for h, n in zip(html, host)], dtype=object)


def with_site_rules(html, url) -> Column:
    return _site_rules(col(html), raw_host(url))


def with_cleaned(df: DataFrame, html: str, url: str, name: str) -> DataFrame:
    """df plus a column: html after site rules, then furniture, in one pass through Python.

    A pass over Arrow batches and not a function of columns, so that whatever
    is later derived from the new column never runs it twice.
    """
    kept = [c for c in df.columns if c != name]
    fields = [f for f in df.schema.fields if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())
            done = [None if h is None else strip_furniture(apply_site_rules(h, n)) for h, n in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(done, pa.string())], names=[*kept, name])

    small_batches(df.sparkSession)
    given = df.select(*kept, F.col(html).alias("_html"), raw_host(url).alias("_host"))
    return given.mapInArrow(run, StructType([*fields, StructField(name, StringType())]))
