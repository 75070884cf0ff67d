"""Requests to a server on this machine, and the command line's arguments."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from folioforge import __version__
from folioforge.__main__ import main
from folioforge.sources.http import IMAGE_HEADERS, PAGE_HEADERS, fetch_one


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        body = {"/page": b"<h1>Page</h1>", "/empty": b""}.get(self.path, b"nope")
        self.send_response(200 if self.path in ("/page", "/empty") else 404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_response(site):
    got = fetch_one(f"{site}/page", PAGE_HEADERS, 5)
    assert got["status"] == 200 and got["body"] == b"<h1>Page</h1>" and got["content_type"] == "text/html; charset=utf-8" and got["fail_reason"] is None
    assert fetch_one(f"{site}/empty", PAGE_HEADERS, 5)["body"] == b""


def test_redirects_give_the_final_address(site):
    assert fetch_one(f"{site}/moved", PAGE_HEADERS, 5)["final_url"] == f"{site}/page"


def test_failures_are_rows_without_progress_noise(site):
    why = fetch_one(f"{site}/missing", PAGE_HEADERS, 5)["fail_reason"]
    assert why.startswith("HTTP 404 | curl: ") and "% Total" not in why
    assert fetch_one(f"{site}/missing", PAGE_HEADERS, 5, fallback=False)["fail_reason"] == "HTTP 404"


def test_images_are_judged_by_their_bytes(site):
    got = fetch_one(f"{site}/missing.png", IMAGE_HEADERS, 5, any_status=True)
    # without curl the request fails; with it the page of the error comes back, without a content type
    assert (got["body"], got["content_type"], got["fail_reason"]) == (b"nope", "", None) or "HTTP 404" in got["fail_reason"]


def test_data_addresses():
    got = fetch_one("data:image/svg+xml;base64,PHN2Zy8+", IMAGE_HEADERS, 5)
    assert got["body"] == b"<svg/>" and got["content_type"] == "image/svg+xml"


def test_arguments(capsys):
    assert main(["--version"]) == 0 and __version__ in capsys.readouterr().out
    assert main(["--help"]) == 0 and "usage" in capsys.readouterr().out
    for wrong in ([], ["https://a.example.com/"], ["a", "b", "c"], ["--unknown", "a", "b"]):
        assert main(wrong) == 1


@pytest.mark.parametrize(("given", "want"), [
    ("http://1.2.3/", "http://1.2.0.3/"), ("http://1.2.3.4./x", "http://1.2.3.4/x"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://017700000001", "http://127.0.0.1/"), ("http://4294967295/", "http://255.255.255.255/"),
    ("http://4294967296/", None), ("http://256.1.1.1/", None), ("http://1.2.3.4.5/", None), ("http://1.2.3.09/", None), ("http://a.1/", None), ("http://1.a.example/", "http://1.a.example/"), ("http://a.0xg/", "http://a.0xg/"),
    ("http://0x/", "http://0.0.0.0/"), ("http://[::1]:80/", "http://[::1]/"), ("http://[0:0:1:0:0:0:0:1]/", "http://[0:0:1::1]/"), ("http://[::FFFF:1.2.3.4]/", "http://[::ffff:102:304]/"), ("http://[1:0:2:3:4:5:6:7]/", "http://[1:0:2:3:4:5:6:7]/"),
    ("http://[0:0:0:0:0:0:0:0]/", "http://[::]/"), ("http://[1::%25eth0]/", None), ("http://[1:2]/", None),
])
def test_numeric_hosts(given, want):
    from folioforge.functions.web import resolve

    assert resolve(None, given) == want
