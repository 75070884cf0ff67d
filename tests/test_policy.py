"""The policies on references, over every pairing of hosts, paths and main pages, against plain Python."""

import itertools
import re
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from folioforge.functions import urls
from folioforge.operators.outcomes import low_signal

HOSTS = [
    "bolt.new", "www.bolt.new", "docs.bolt.new", "descript.com", "qodo.ai", "braintrust.dev", "claude.ai", "www.claude.ai", "anthropic.com", "www.anthropic.com", "claude.com", "sub.claude.com",
    "github.com", "raw.githubusercontent.com", "notgithub.com", "arxiv.org", "export.arxiv.org", "en.wikipedia.org", "help.tea.example", "developers.tea.example", "api.tea.example", "shop.tea.example", "tea.example", "10.1.2.3", "[2001:db8::1]",
]
PATHS = [
    "", "/", "//", "/home", "/home/", "/HOME", "/claude-code", "/claude-code/", "/product/claude-code", "/code", "/code/", "/code/x", "/docs", "/docs/a", "/docsx", "/Blog/1", "/blog", "/papers/p.html", "/x.pdf", "/x.PDF?y=1", "/.md", "/a.b/c",
    "/?utm=docs", "/#docs", "/pricing", "/a/docs", "/customers/", "/case-studies/z",
]
MAINS = ["https://leaf.example/notes/brew", "https://bolt.new/", "https://www.tea.example/x", "http://10.1.2.3/", "https://[2001:db8::1]/a", "mailto:x@y.example"]


def host(url):
    return re.sub("^www\\.", "", (urlsplit(url).netloc.rpartition("@")[2].lower() if "://" in url else ""))


def path(url):
    return urlsplit(url).path.rstrip("/") or "/"


def same_site(a, b):
    a, b = host(a), host(b)
    if not a or not b:
        return True
    if any(":" in x or re.fullmatch(r"\d+(\.\d+){3}", x) for x in (a, b)):
        return a == b
    return a.split(".")[-2:] == b.split(".")[-2:]


def source_like(url):
    h, p = host(url), path(url).lower()
    extension = re.search(r"[^/](\.[^./]*)$", p)
    return (
        any(h == x or h.endswith("." + x) for x in urls.SOURCE_HOSTS) or h.split(".")[0] in urls.SOURCE_LABELS
        or p.split("/")[1] in urls.SOURCE_PREFIXES or bool(extension and extension[1][1:] in urls.SOURCE_EXTENSIONS)
    )


def homepage(url):
    return path(url) in ("/", "/home")


def landing(url):
    return (host(url) in urls.KNOWN_HOMEPAGES and homepage(url)) or host(url) + path(url).lower() in urls.KNOWN_LANDINGS


def test_policies(spark):
    pairs = [(m, f"https://{h}{p}") for m, h, p in itertools.product(MAINS, HOSTS, PATHS)]
    frame = spark.createDataFrame(pairs, "main string, ref string").withColumn("n", F.lit(2))
    told = frame.select("main", "ref", urls.same_site("main", "ref").alias("s"), urls.is_source_like("ref").alias("l"), urls.is_homepage("ref").alias("h"), urls.is_known_landing("ref").alias("k"), urls.skip_before_fetch("main", "ref").alias("b"), low_signal("main", "ref", "n").alias("a"))
    wrong = []
    for r in told.collect():
        s, like, home, known = same_site(r.main, r.ref), source_like(r.ref), homepage(r.ref), landing(r.ref)
        if (r.s, r.l, r.h, r.k, r.b, r.a) != (s, like, home, known, not s and not like and known, not s and not like and (home or known)):
            wrong.append((r, s, like, home, known))
    assert not wrong, wrong[:5]
    assert {r for r in told.where("b").select("ref").distinct().toPandas()["ref"]} >= {"https://bolt.new/", "https://www.bolt.new/home", "https://claude.ai/code", "https://claude.com/product/claude-code", "https://www.anthropic.com/claude-code/"}


def test_one_signal_is_too_few(spark):
    frame = spark.createDataFrame([(n,) for n in range(4)], "n int").select("n", F.lit("https://leaf.example/x").alias("m"), F.lit("https://shop.tea.example/").alias("r"))
    assert {r.n: r.a for r in frame.select("n", low_signal("m", "r", "n").alias("a")).collect()} == {0: False, 1: False, 2: True, 3: True}
