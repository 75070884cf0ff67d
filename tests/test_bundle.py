"""End to end: bundles from captured responses, with the outcomes that each kind of reference has."""

import json
import os
import struct
import zlib

import pytest

from folioforge.plans.bundle import bundles
from folioforge.sources.captures import SOURCES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def png(width: int, height: int, pad: int = 600) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"k\0" + b"x" * pad) + chunk(b"IEND", b"")


MAIN = """<html><head><meta property="og:title" content="A &amp; B"><title>no</title></head><body><nav><a href="/chrome">chrome</a></nav>
<main><article><h1>Heading</h1><p>See <a href="/ref#part">the reference</a>, <a href="/ref">again</a>, <a href="/doc.pdf">paper</a>,
<a href="https://gone.example.org/x">gone</a>, <a href="/moved">moved</a>, <a href="https://www.bolt.new/">tool</a>, <a href="https://shop.example.org/">shop</a>, <a href="mailto:a@b.c">mail</a>.</p>
<img src="/pics/figure-one.png" alt="Figure One"><img src="/logo.png" alt="Site logo"><img src="/tiny.png" alt=""><img src="/not.png"><img src="/missing.png" alt="m">
<ul><li>one</li><li>two</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td><ul><li>a</li><li>b</li></ul></td><td>2</td></tr></table></article></main></body></html>"""
REF = "<html><body><h1>Reference</h1><p>Plain <b>bold</b> <a href='x'>x</a> <a href=\"/start\">back</a></p></body></html>"
SHOP = "<html><body><h1>Shop</h1><p>Get started. Trusted by many. Pricing.</p></body></html>"


@pytest.fixture(scope="module")
def made(spark):
    def source(url, final, kind, body, why=None):
        return (url, url, final, 200, kind, body if isinstance(body, bytes) else body.encode() if body is not None else None, "fetch", why)

    base = "https://site.example.com"
    sources = spark.createDataFrame(
        [
            source(f"{base}/start", f"{base}/start", "text/html; charset=utf-8", MAIN),
            source(f"{base}/ref#part", f"{base}/ref", "text/html", REF),
            source(f"{base}/doc.pdf", f"{base}/doc.pdf", "application/octet-stream", b"%PDF-1.7\x00"),
            source(f"{base}/moved", f"{base}/ref", "text/html", REF),
            source("https://shop.example.org/", "https://shop.example.org/", "text/html", SHOP),
            source("https://gone.example.org/x", None, None, None, "HTTP 404"),
        ],
        SOURCES,
    )
    images = spark.createDataFrame(
        [
            (f"{base}/pics/figure-one.png", bytearray(png(120, 90)), "image/png", None),
            (f"{base}/tiny.png", bytearray(png(10, 10)), "image/png", None),
            (f"{base}/not.png", bytearray(b"<html>no image here</html>"), "image/gif", None),
        ],
        "image_url string, body binary, content_type string, fail_reason string",
    )
    mains = spark.createDataFrame([(7, f"{base}/start")], "bundle_id long, url string")
    return bundles(mains, sources, images)


def test_outcomes(made):
    rows = {r.link_url: r for r in made["outcomes"].collect()}
    base = "https://site.example.com"
    assert rows[f"{base}/ref#part"].kind == "readable" and rows[f"{base}/ref#part"].relative_path == "references/reference.md"
    assert rows[f"{base}/ref#part"].link_label == "the reference"
    assert rows[f"{base}/doc.pdf"].kind == "asset" and rows[f"{base}/doc.pdf"].asset_path == "references/assets/doc-pdf.pdf"
    assert rows[f"{base}/moved"].kind == "alias" and rows[f"{base}/moved"].relative_path == "references/reference.md"
    assert rows["https://gone.example.org/x"].kind == "failed" and rows["https://gone.example.org/x"].fail_reason == "HTTP 404"
    assert rows["https://www.bolt.new/"].kind == "skipped" and rows["https://www.bolt.new/"].title is None
    assert rows["https://shop.example.org/"].kind == "skipped" and rows["https://shop.example.org/"].title == "Shop"
    assert len(rows) == 6


def test_manifest(made):
    told = json.loads(made["manifest"].first().json)
    assert list(told) == ["references/reference.md", "references/doc-pdf.md", "references/x.md", "skipped"]
    assert told["references/reference.md"] == {
        "original_url": "https://site.example.com/ref#part", "title": "Reference", "content_type": "text/html", "kind": "html",
        "final_url": "https://site.example.com/ref", "additional_original_urls": ["https://site.example.com/moved"],
    }
    assert told["references/x.md"]["fail_reason"] == "HTTP 404" and told["references/x.md"]["content_type"] == ""
    assert told["skipped"]["https://www.bolt.new/"] == {"original_url": "https://www.bolt.new/", "kind": "skipped", "skipped_reason": "low_signal_marketing_reference", "label": "tool"}


def test_images(made):
    rows = {r.image_url.rsplit("/", 1)[1]: r for r in made["asset_outcomes"].where("page_path = 'index.md'").collect()}
    assert rows["figure-one.png"].relative_path == "assets/01-figure-one.png" and rows["figure-one.png"].kind == "localized"
    assert rows["tiny.png"].reason == "tiny_dimensions" and rows["not.png"].reason == "not_image" and rows["missing.png"].kind == "failed"
    assert "logo.png" not in rows


def test_markdown(made):
    pages = {r.relative_path: r.markdown for r in made["rendered"].collect()}
    index = pages["index.md"]
    assert index.startswith("# A & B\n\nSource: https://site.example.com/start\nContent-Type: text/html; charset=utf-8\n\n## Direct References\n\n- [Reference](references/reference.md)\n")
    assert "[the reference](references/reference.md)" in index and "[paper](references/doc-pdf.md)" in index and "[moved](references/reference.md)" in index
    assert "Heading" not in index and "chrome" not in index and "![Figure One](assets/01-figure-one.png)" in index and "logo" not in index and "tiny" not in index
    assert "![m](https://site.example.com/missing.png)" in index and "[mail](mailto:a@b.c)" in index
    assert "-   one\n-   two" in index and "| k | v |\n| --- | --- |\n| a<br>b | 2 |" in index
    assert "Plain **bold**" in pages["references/reference.md"] and "[back](../index.md)" in pages["references/reference.md"]
    assert "Failed to download this source." in pages["references/x.md"]
    assert "[assets/doc-pdf.pdf](assets/doc-pdf.pdf)" in pages["references/doc-pdf.md"]


def test_bundle_files(made, tmp_path):
    from folioforge.sources.sinks import write_bundle

    out = tmp_path / "bundle"
    out.mkdir()
    (out / "old").write_text("x")
    write_bundle(made, 7, str(out))
    assert (out / "references/assets/doc-pdf.pdf").read_bytes() == b"%PDF-1.7\x00" and not (out / "old").exists()
    assert (out / "assets/01-figure-one.png").read_bytes() == png(120, 90)
    assert json.loads((out / "references/references.json").read_text())["references/doc-pdf.md"]["kind"] == "asset"


def test_all_bundles_as_files(made, tmp_path):
    from folioforge.sources.sinks import write_files

    root = tmp_path / "bundles"
    write_files(made, str(root))
    write_files(made, str(root))
    assert (root / "7/references/assets/doc-pdf.pdf").read_bytes() == b"%PDF-1.7\x00"
    assert (root / "7/index.md").read_text().startswith("# A & B\n") and len(list((root / "7").rglob("*.md"))) == 4
    assert json.loads((root / "7/references/references.json").read_text())["references/doc-pdf.md"]["kind"] == "asset"


def test_name_clashes(spark):
    """A counted name that is another reference's own name: the first free one is taken, in link order."""
    from folioforge.operators.outcomes import allocate_names

    titles = ["foo", "foo", "foo-2", "foo", "Bar", "bar", "foo 2"]
    rows = [(b, k, t) for b in (1, 2) for k, t in enumerate(titles if b == 1 else titles[:2])]
    got = {(r.bundle_id, r.pos): r.relative_path for r in allocate_names(spark.createDataFrame(rows, "bundle_id long, pos int, title string")).collect()}
    names = ["foo", "foo-2", "foo-2-2", "foo-3", "bar", "bar-2", "foo-2-3"]
    assert got == {(1, k): f"references/{n}.md" for k, n in enumerate(names)} | {(2, k): f"references/{n}.md" for k, n in enumerate(names[:2])}


def test_plans_read_stored_outcomes(spark):
    """Each table of a bundle reads a few stored tables, not the pages again and again."""
    from folioforge.plans.registry import QUERIES

    for name in ("reference_outcomes", "link_map", "reference_section", "manifest"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 5 and "Python" not in plan and "mapInArrow" not in plan, name


def test_late_reference(spark, tmp_path):
    """A source that comes after its bundle has been made: the bundle is made again."""
    from folioforge.streaming.captures import read_stream, write_bundles

    base = "https://late.example.com"
    page = f'<html><body><article><p><a href="{base}/b">B</a></p></article></body></html>'
    schema = SOURCES + ", role string, bundle_id long, ingested timestamp"

    def land(url, html, role, bundle):
        from datetime import datetime

        row = (url, url, url, 200, "text/html", html.encode(), "fetch", None, role, bundle, datetime(2024, 1, 1))
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    images = spark.createDataFrame([], "image_url string, body binary, content_type string, fail_reason string")
    for url, html, role, bundle in ((f"{base}/a", page, "main", 3), (f"{base}/b", "<h1>Late</h1>", "reference", None)):
        land(url, html, role, bundle)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        write_bundles(stream, f"{tmp_path}/out", f"{tmp_path}/state", images).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
    kinds = {r.batch: r.kind for r in spark.read.parquet(f"{tmp_path}/out/outcomes").select("batch", "kind").collect()}
    assert kinds == {0: "failed", 1: "readable"} and read_stream is not None
