"""Live responses: a server on this machine, limits, hosts, pieces, and a page saved with its progress."""

import json
import os
import subprocess
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from folioforge.sources import captures, http
from folioforge.sources.http import PAGE_HEADERS, ask, fetch_one

BIG = 300 << 20


class Site(BaseHTTPRequestHandler):
    seen: list = []
    now: dict = {}
    most: dict = {}
    lock = threading.Lock()

    def do_GET(self):
        host = self.headers["Host"].split(":")[0]
        with self.lock:
            self.seen.append((host, self.path, time.monotonic()))
            self.now[host] = self.now.get(host, 0) + 1
            self.most[host] = max(self.most.get(host, 0), self.now[host])
        try:
            self.answer()
        except (BrokenPipeError, ConnectionResetError):
            pass
        finally:
            with self.lock:
                self.now[host] -= 1

    def answer(self):
        name, _, size = self.path.strip("/").partition("/")
        if name == "slow":
            time.sleep(0.05)
        if name == "bytes":
            self.send_response(200)
            self.send_header("Content-Type", "application/pdf")
            self.send_header("Content-Length", size)
            self.end_headers()
            left, piece = int(size), b"%PDF-1.7" + b"x" * ((1 << 20) - 8)
            while left > 0:
                self.wfile.write(piece[: min(left, len(piece))])
                left -= len(piece)
            return
        if name == "short":  # says more than comes
            self.send_response(200)
            self.send_header("Content-Length", "100")
            self.end_headers()
            self.wfile.write(b"half")
            return
        self.send_response(404 if name == "gone" else 200)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(f"<h1>{name}</h1>".encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def port():
    server = ThreadingHTTPServer(("0.0.0.0", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port
    server.shutdown()


def test_limits(port):
    url = f"http://127.0.0.1:{port}/bytes/100000"
    at = fetch_one(url, PAGE_HEADERS, 5, limit=100_000)
    assert len(at["body"]) == 100_000 and at["fail_reason"] is None and at["fetch_method"] == "fetch"
    over = fetch_one(url, PAGE_HEADERS, 5, limit=99_999)
    assert over["body"] is None and over["fail_reason"] == "Response is longer than 99999 bytes"
    assert fetch_one("data:text/plain,abcd", PAGE_HEADERS, 5, limit=4)["body"] == b"abcd" and fetch_one("data:text/plain,abcd", PAGE_HEADERS, 5, limit=3)["fail_reason"]


def curl_that(tmp_path, monkeypatch, script):
    (tmp_path / "bin").mkdir()
    path = tmp_path / "bin" / "curl"
    path.write_text(f"#!{sys.executable}\nimport sys\n{script}")
    path.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}/bin{os.pathsep}{os.environ['PATH']}")


def test_limits_of_the_second_attempt(tmp_path, monkeypatch):
    meta = "sys.stderr.write('--folioforge--200\\thttps://a.example.com/x\\ttext/plain')"
    curl_that(tmp_path, monkeypatch, f"sys.stdout.write('y' * 1000); {meta}")
    got = lambda **k: fetch_one("http://127.0.0.1:9/x", PAGE_HEADERS, 5, **k)
    assert got(limit=1000) == {"status": 200, "final_url": "https://a.example.com/x", "content_type": "text/plain", "body": b"y" * 1000, "fetch_method": "curl-fallback", "fail_reason": None}
    assert got(limit=999)["fail_reason"] == "Response is longer than 999 bytes" and got(limit=999)["body"] is None


@pytest.mark.parametrize("more", [0, 1])
def test_limit_of_what_is_said(tmp_path, monkeypatch, more):
    meta = "--folioforge--200\\thttps://a.example.com/x\\ttext/plain"
    size = http.META_LIMIT - len(meta.encode().decode("unicode_escape")) + more
    curl_that(tmp_path, monkeypatch, f"sys.stdout.write('y'); sys.stderr.write('n' * {size} + '{meta}')")
    got = fetch_one("http://127.0.0.1:9/x", PAGE_HEADERS, 5)
    assert (got["body"], got["fail_reason"]) == ((None, f"What is said of the response is longer than {http.META_LIMIT} bytes") if more else (b"y", None))


def test_a_body_that_ends_early_is_asked_again(port):
    rows = list(ask(f"http://127.0.0.1:{port}/short", PAGE_HEADERS, 5, fallback=False))
    assert [r["body"] for r in rows] == [b"half", None] and rows[-1]["fail_reason"] == "Response ended early" and rows[-1]["attempt"] == 1


WORKER = """
import resource, sys
sys.path.insert(0, {repo!r})
from folioforge.sources.http import _ask_all

used = next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("VmSize")) << 10
resource.setrlimit(resource.RLIMIT_AS, (used + (200 << 20),) * 2)
size = rows = 0
for batch in _ask_all([("a", {url!r}, None, "h")], True, 0.0, 400 << 20, 1 << 20, 60):
    for row in batch.to_pylist():
        rows += 1
        size += len(row["body"] or b"")
        assert row["fail_reason"] is None, row["fail_reason"]
assert size == {size} and rows > 290, (size, rows)
"""


def test_a_long_body_needs_little_memory(port):
    """300 MB through a worker that may use 200 MB more than it starts with."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", WORKER.format(repo=repo, url=f"http://127.0.0.1:{port}/bytes/{BIG}", size=BIG)], capture_output=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]


def test_hosts_are_asked_one_at_a_time(spark, port, tmp_path):
    """By the source: four tasks, five hosts; none is asked twice at once, nor sooner than the delay."""
    Site.seen.clear(), Site.most.clear()
    urls = [(f"http://127.0.0.{h}:{port}/slow/{k}",) for h in range(1, 6) for k in range(6)]
    http.register(spark)
    http.save_addresses(spark.createDataFrame(urls + urls[:3] + [(None,)], "url string"), f"{tmp_path}/asked", images=True, hosts=4)
    read = spark.read.format("folioforge_http").option("images", "true").option("delay", "0.1").load(f"{tmp_path}/asked")
    assert read.schema.simpleString() == spark.createDataFrame([], captures.CHUNKS).schema.simpleString()
    got = captures.assembled(spark.createDataFrame(read.collect(), read.schema), every=True).collect()
    assert sorted(r.requested_url for r in got) == sorted(u for u, in urls) and {bytes(r.body) for r in got} == {b"<h1>slow</h1>"}
    assert set(Site.most.values()) == {1} and len(Site.seen) == 30
    for h in Site.most:
        times = [t for host, _, t in Site.seen if host == h]
        assert min(b - a for a, b in zip(times, times[1:])) >= 0.1
    # a task takes its hosts by turns: it need not wait for one
    folders = {h: [p for p in os.listdir(tmp_path / "asked") if p.startswith("hosts=")] for h in Site.most}
    assert len(next(iter(folders.values()))) > 1


def test_pieces_and_bodies(spark, port, tmp_path):
    """Text is put together from its pieces, an asset is not, and its file gets them one by one."""
    from folioforge.plans.bundle import bundles
    from folioforge.sources.sinks import write_files
    from folioforge.storage import stored

    base = f"http://127.0.0.1:{port}"
    chunks = stored(http.fetch_chunks(spark.createDataFrame([(f"{base}/{x}",) for x in ("bytes/2500000", "page", "gone", "bytes/0")], "url string"), images=True, chunk=1 << 20, hosts=3))
    assert sorted(len(r.body) for r in chunks.where("body is not null and requested_url like '%2500000'").collect()) == [402_848, 1 << 20, 1 << 20]
    sources = {r.requested_url.removeprefix(base + "/"): r for r in captures.assembled(chunks).collect()}
    assert sources["bytes/2500000"].body is None and bytes(sources["bytes/2500000"].head[:5]) == b"%PDF-" and bytes(sources["page"].body) == b"<h1>page</h1>"
    assert sources["bytes/0"].fail_reason is None and sources["bytes/0"].body is None and bytes(sources["bytes/0"].head) == b""
    html = f'<article><a href="{base}/bytes/2500000">b</a> <a href="{base}/page">p</a> <a href="{base}/bytes/0">n</a></article>'
    main = ("https://m.example.com/a", "https://m.example.com/a", 0, 0, bytearray(html.encode()), False) + (None,) * 5
    end = ("https://m.example.com/a", "https://m.example.com/a", 0, None, None, True, "https://m.example.com/a", 200, "text/html", "fetch", None)
    every = stored(chunks.unionByName(spark.createDataFrame([main, end], captures.CHUNKS)))
    mains = spark.createDataFrame([(7, "https://m.example.com/a")], "bundle_id long, url string")
    made = bundles(mains, captures.assembled(every), spark.createDataFrame([], "image_url string, body binary, content_type string, fail_reason string"), every)
    write_files(made, str(tmp_path))
    names = {r.link_url.removeprefix(base + "/"): (r.kind, r.asset_path) for r in made["outcomes"].collect()}
    assert names["bytes/2500000"][0] == names["bytes/0"][0] == "asset" and names["page"][0] == "readable"
    want = (b"%PDF-1.7" + b"x" * ((1 << 20) - 8)) * 3
    assert (tmp_path / "7" / names["bytes/2500000"][1]).read_bytes() == want[:2_500_000] and (tmp_path / "7" / names["bytes/0"][1]).read_bytes() == b""


def test_a_saved_page_tells_its_progress(spark, tmp_path):
    """The four lines, from the library: main source, skipped unread, asked, skipped for what it is."""
    from pyspark.sql import functions as F

    from folioforge.plans.live import save_page

    base = "https://site.example.com"
    pages = {
        f"{base}/start": f'<h1>Start</h1><article><a href="{base}/ref">r</a> <a href="https://www.bolt.new/">t</a> <a href="https://shop.example.org/">s</a> <a href="{base}/no">n</a></article>',
        f"{base}/ref": "<h1>Reference</h1>", "https://shop.example.org/": "<h1>Shop</h1><p>Get started. Trusted by many. Pricing.</p>",
    }

    def answered(urls, url="url"):
        rows = []
        for u in [r[0] for r in urls.select(url).distinct().collect()]:
            if u in pages:
                rows += [(u, u, 0, 0, bytearray(pages[u].encode()), False) + (None,) * 5, (u, u, 0, None, None, True, u, 200, "text/html", "fetch", None)]
            else:
                rows.append((u, u, 1, None, None, True, None, None, "", "fetch", "HTTP 404"))
        return spark.createDataFrame(rows, captures.CHUNKS)

    said = []
    counts = save_page(spark, f"{base}/start", str(tmp_path / "out"), progress=said.append, ask=answered)
    assert said == [
        f"Fetching main source {base}/start ...", f"Fetching reference source {base}/ref ...", "Skipping low-signal reference https://www.bolt.new/ ...",
        "Fetching reference source https://shop.example.org/ ...", f"Fetching reference source {base}/no ...", "Skipping low-signal reference https://shop.example.org/ ...",
    ]
    assert counts == {"readable": 1, "asset": 0, "failed": 1, "alias": 0, "skipped": 2}
    assert set(json.loads((tmp_path / "out/references/references.json").read_text())) == {"references/reference.md", "references/no.md", "skipped"}
    with pytest.raises(RuntimeError, match="HTTP 404"):
        save_page(spark, f"{base}/no", str(tmp_path / "out"), progress=said.append, ask=answered)
    assert (tmp_path / "out/index.md").exists() and F is not None
