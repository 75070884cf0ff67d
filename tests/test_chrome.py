"""Balanced removal on nested and broken markup, and the site rules on pages shaped like the real ones."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folioforge.functions.arrow import python_udf
from folioforge.functions.text import decode_html
from folioforge.functions.urls import resolve_asset
from folioforge.operators import chrome
from folioforge.operators.chrome import Element, strip_furniture, without
from folioforge.session import BATCH_ROWS


@pytest.mark.parametrize(
    ("html", "left"),
    [
        ("a<nav>b<nav>c</nav>d</nav>e", "ae"),
        ("a<NAV class=x>b</nav >c<nav>d</nav>e", "ace"),
        ("a<nav>b<nav>c</nav>d", "a<nav>b<nav>c</nav>d"),  # the first never closes, so the second stays too
        ("a<nav>b</nav>c<nav>d", "ac<nav>d"),
        ("a</nav>b<nav>c</nav>d", "a</nav>bd"),
        ("<navy>a</navy><nav/>b", "<navy>a</navy><nav/>b"),
        ("<nav><header>a</nav>b</header>c<header>d</header>", "b</header>c"),
        ("<header>a<nav>b</nav>c</header>d", "d"),
        ("x [ Edit ] y [edit]", "x  y "),
        ("", ""),
    ],
)
def test_furniture(html, left):
    assert strip_furniture(html) == left


def test_furniture_roles():
    role = lambda tag, words, inside="x": f"<{tag} class='a' role={words}>{inside}</{tag}>"
    assert strip_furniture("a" + role("div", '"Banner"') + role("div", "search") + role("div", "'main navigation'") + "b") == "ab"
    kept = role("section", '"search"') + role("div", '"main"') + "<div data-role=x>y</div>"
    assert strip_furniture(kept) == kept
    assert strip_furniture(role("section", '"complementary"', "<section>s</section>")) == ""


def test_furniture_most():
    assert without("<nav>a</nav>" * 1001 + "b", (Element("nav"),)) == "<nav>a</nav>b"
    assert without("<nav>" * 1001 + "</nav>" * 1001 + "b", (Element("nav"),)) == "b"


def site(html, host):
    return chrome.apply_site_rules(html, host)


def test_arxiv():
    """Each piece of furniture on its own around one paragraph, then each place where a page ends."""
    kept = "<p>Tides move boats.</p>"
    gone = ['<div class="subheader">one<div>two</div></div>', '<div class="a header-breadcrumbs-mobile b"><i>three</i></div>', '<div class="browse">four<div>five</div></div>', '<div class="extra-ref-cite"><ul></ul></div>', '<a href="f" class="mobile-submission-download">six</a>']
    for piece in gone:
        assert site(f"{piece}{kept}{piece}", "arxiv.org") == kept
    assert site("".join(gone) + f"<div>{kept}</div>" + "".join(gone), "export.arxiv.org") == f"<div>{kept}</div>"
    for stop in ("<h3>References &amp; Citations</h3>", "<h3> References & Citations </h3>", "<div class='bookmarks'>seven</div>", "<div id='labstabs'>eight</div>"):
        assert site(f"{kept}{stop}<p>nine</p>", "arxiv.org") == kept


def test_wikipedia():
    inner = "<p>Rivers bend.</p>"
    wrap = lambda x: f'<div id="mw-content-text"><div class="mw-content-ltr mw-parser-output">{x}</div> <noscript>p</noscript></div>'
    pieces = ['<div class="shortdescription">q</div>', '<div class="mw-subjectpageheader">r</div>', '<p class="mw-empty-elt"></p>', '<table class="navbox"><tr><td>t</td></tr></table>', '<meta property="mw:PageProp/toc">']
    for piece in pieces:
        assert site(wrap(piece + inner + piece), "en.wikipedia.org").strip() == inner
    assert site(wrap("<p>Rivers<span class=\"mw-editsection\">u<span>v</span></span> bend.</p>"), "fr.wikipedia.org") == inner
    assert site(wrap(f'{inner}<div class="mw-heading mw-heading2"><h2 id="References">w</h2></div><p>x</p>'), "en.wikipedia.org") == inner
    assert site(inner, "de.wikipedia.org") == inner


def test_github():
    readme = '<article class="markdown-body entry"><p>Run it.</p></article>'
    assert site(f"<ul><li>files</li></ul>{readme}<aside>more</aside>", "github.com") == f"<main><article>{readme}</article></main>"
    assert site("<p>a</p>", "github.com") == site("<p>a</p>", "notgithub.com") == "<p>a</p>"


def test_bolt():
    assert site("<h1 id='k'>Sky <b>blue</b></h1><h1>Sea</h1>", "bolt.new") == "<h2 id='k'>Sky <b>blue</b></h2><h1>Sea</h1>"
    assert site("<p>Sand</p><button>l<button>m</button></button><p>or  import\nfrom</p>", "bolt.new") == "<p>Sand</p>"
    cleaned = site("<header>Moon</header><p>Sand</p><div><h2>Your company&#x27;s design system, now in Bolt</h2><p>n</p></div>", "bolt.new")
    assert cleaned == "<header>Moon</header><p>Sand</p><div></body></html>" and "Moon" not in strip_furniture(cleaned)


def test_own_rule(monkeypatch):
    monkeypatch.setattr(chrome, "SITE_RULES", list(chrome.SITE_RULES))
    chrome.register_site_rule(chrome.SiteRule("own", r"^own\.example$", (chrome.Stop(("<hr>",)), str.upper)))
    chrome.register_site_rule(chrome.SiteRule("own", r"^own\.example$", (chrome.Stop(("<br>",)), lambda h: re.sub("a", "b", h))))
    assert site("aa<br>c<hr>", "own.example") == "bb"


def test_removal_by_table(spark):
    """Tags as rows give what reading one page gives, on nested, unclosed and crossing markup, roles of every form, and a very long page."""
    import random

    from folioforge.operators.balance import without_by_table

    draw = random.Random(12)
    tags = ["<nav>", "</nav>", "<NAV x>", "</nav >", "<header>", "</header>", "<header\n a='>'>", '<div role="Search x">', "<div role=banner>", "<div role='main'>", "<div>", "</div>", "<section data-role=\"a\" role='complementary'>", "<section>", "</section>", "<aside>", "</aside>", "<nav <header>", "<navy>", "é🙂", "t ", "<"]
    htmls = ["", None, "plain", "<nav>" * 1001 + "</nav>" * 1001 + "b", "<nav>a</nav>" * 1003 + "<aside>b</aside>c", ("<div role=search>x<nav>y</nav></div>é" * 20_000)]
    htmls += ["".join(draw.choice(tags) for _ in range(draw.randrange(30))) for _ in range(600)]
    htmls += ["".join(f"<{t}>" + draw.choice(["", "x", "<nav>n</nav>"]) + f"</{t}>" for t in draw.choices(["nav", "header", "footer", "aside"], k=6)) for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(htmls)), "k int, html string")
    got = {r.k: r.html for r in without_by_table(frame, ["k"]).collect()}
    assert got == {k: None if h is None else without(h, chrome.FURNITURE) for k, h in enumerate(htmls)}
    byclass = (Element("div", "class", r"(^|\s)ad(\s|$)"),)
    frame = spark.createDataFrame([(1, "a<div class='x AD'>b<div>c</div></div>d<div class=ads>e</div>")], "k int, html string")
    assert without_by_table(frame, ["k"], elements=byclass).first().html == "ad<div class=ads>e</div>"


def test_small_batches(spark):
    """What runs in Python over pages gets few of them at once, however many there are."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("<p>x</p>"), F.col("id").cast("string")).alias("html"), F.lit("https://example.org/").alias("url"))
    steps = [
        lambda: chrome.with_cleaned(pages, "html", "url", "c"), lambda: pages.select(chrome.without_furniture("html")), lambda: pages.select(chrome.with_site_rules("html", "url")),
        lambda: pages.select(resolve_asset("url", "html")), lambda: pages.select(decode_html("html")),
    ]
    for step in steps:
        spark.conf.set(limit, "10000")
        assert step().count() == 3000
        assert int(spark.conf.get(limit)) == BATCH_ROWS

    @python_udf(IntegerType())
    def rows(html: pd.Series) -> pd.Series:
        return pd.Series([len(html)] * len(html))

    spark.conf.set(limit, "10000")
    assert pages.select(rows("html").alias("n")).agg(F.max("n")).first()[0] == BATCH_ROWS
