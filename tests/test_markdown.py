"""HTML to Markdown on fixed pages: what the usual converter, its table and strike-through rules and the two own rules make of them."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import render
from folioforge.operators.markdown import convert
from folioforge.session import BATCH_ROWS

CASES = {
    "headings": ("<h1>A</h1><h3>B <em>c</em></h3><p>d</p>", "# A\n\n### B _c_\n\nd"),
    "emphasis": ("<p><b>a</b> <i> b </i>c <del>d</del> <strong></strong></p>", "**a** _b_ c ~~d~~"),
    "spaces": ("<p>a\n  b</p>\n\n<div>  c  </div>", "a b\n\nc"),
    "breaks": ("<p>a <br> b<br/>c</p>", "a  \nb  \nc"),
    "escapes": ("<p>1. a * b _ c [d] `e` # f \\</p><p># g</p><p>- h</p><p>&gt; i</p>", "1\\. a \\* b \\_ c \\[d\\] \\`e\\` # f \\\\\n\n\\# g\n\n\\- h\n\n\\> i"),
    "entities": ("<p>a &amp; b&nbsp;&lt;c&gt;</p>", "a & b\u00a0<c>"),
    "bullets": ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "-   a\n-   b\n    -   c"),
    "numbers": ('<ol start="3"><li>a</li><li><p>b</p><p>c</p></li></ol>', "3.  a\n4.  b\n    \n    c"),
    "code": ("<p><code>a`b</code></p><pre><code>x\n  y\n</code></pre>", "``a`b``\n\n```\nx\n  y\n```"),
    "fences": ("<pre><code>```\nz</code></pre>", "````\n```\nz\n````"),
    "quote": ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
    "rule": ("<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    "links": ('<p><a href="/x" title="t">a</a> <a>b</a> <a href="/y"></a></p>', '[a](/x "t") b'),
    "images": ('<p><img src="/i.png" alt="A"><img alt="B"></p>', "![A](/i.png)"),
    "table": (
        "<table><thead><tr><th>k</th><th align='right'>v</th></tr></thead><tbody><tr><td>a</td><td>1</td></tr></tbody></table>",
        "| k | v |\n| --- | --: |\n| a | 1 |",
    ),
    "list cells": (
        "<table><tr><th>k</th><th>v</th></tr>\n<tr>\n<td>plain</td>\n<td><ul><li>first</li><li>second</li></ul><p>* third</p></td></tr></table>",
        "| k | v |\n| --- | --- |\n| plain | first<br>second<br>\\* third |",
    ),
    "cards": (
        '<p>x</p><a href="/c"><img src="/a.png" alt="A"><h3>Title  one</h3><p>some <b>text</b></p><img src="/b.png"></a><p>y</p>',
        "x\n\n![A](/a.png)\n\n![](/b.png)\n\n[Title one -- some text](/c)\n\ny",
    ),
    "card of an icon": ('<a href="/c"><img src="" alt="icon"></a>', "[/c](/c)"),
    "no card": ('<p><a href="/c"><span><img src="/a.png"></span> t</a></p>', "[![](/a.png) t](/c)"),
    "dropped": ("<nav>n</nav><p>a</p><script>s</script><footer>f</footer><style>c</style><noscript>o</noscript><header>h</header>", "a"),
    "broken": ("<p>a <b>b<p>c</b> d<ul><li>e<li>f</ul>", "a **b**\n\n**c** d\n\n-   e\n-   f"),
    "long": ("<div>" + "word " * 500 + "</div><h1>After</h1>", ("word " * 500).strip() + "\n\n# After"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_convert(name):
    html, want = CASES[name]
    assert convert(html) == want


def test_small_batches(spark):
    """Rendering gets few pages at once, however many there are."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    none = F.array().cast("array<struct<key:string,path:string>>")
    pages = spark.range(0, 3000, 1, 1).select(F.lit("<p>x</p>").alias("html"), F.lit("https://example.org/").alias("url"), none.alias("t"), none.alias("k"))
    for step in (lambda: render.localize("html", "url", "t", "k"), lambda: render.to_markdown("html")):
        spark.conf.set(limit, "10000")
        assert pages.select(step().alias("x")).distinct().count() == 1
        assert int(spark.conf.get(limit)) == BATCH_ROWS
