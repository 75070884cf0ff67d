"""Live responses: asked on the executors, host by host, and read in chunks of bounded size."""

from __future__ import annotations

import base64
import os
import re
import subprocess
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioforge.functions.urls import canonical, raw_host, upgraded, validation_error
from folioforge.sources.captures import CHUNKS, SOURCES, assembled
from folioforge.storage import stored

# Time limits in seconds, request headers, and the most bytes of an image and of what curl says about a response.
PAGE_TIMEOUT, IMAGE_TIMEOUT = 30, 20
PAGE_HEADERS = {
    "User-Agent": "Mozilla/5.0 (compatible; folioforge)",
    "Accept": "text/markdown,text/html;q=0.9,application/xhtml+xml;q=0.8,*/*;q=0.5",
    "Accept-Language": "en-US,en;q=0.9",
}
IMAGE_HEADERS = PAGE_HEADERS | {"Accept": "image/avif,image/webp,image/png,image/svg+xml,image/*;q=0.8,*/*;q=0.5"}
IMAGE_LIMIT, META_LIMIT = 30 << 20, 1 << 20

#: Bytes of one chunk of a body.
CHUNK = 1 << 20

_TOLD = {"final_url": None, "status": None, "content_type": "", "fetch_method": "fetch", "fail_reason": None}


class TooLong(Exception):
    """A body or what is said about it goes on beyond its limit."""


def _bounded(parts: Iterable[bytes], limit: int | None) -> Iterator[bytes]:
    size = 0
    for part in parts:
        size += len(part)
        if limit is not None and size > limit:
            raise TooLong(f"Response is longer than {limit} bytes")
        yield part


def ask(url: str, headers: dict[str, str], timeout: float, fallback: bool = True, *, any_status: bool = False, limit: int | None = None, chunk: int = CHUNK) -> Iterator[dict]:
    """One response, piece by piece: attempt, chunk and body of each piece, and last of all a row without a body that tells how it went.

    At most one chunk is held. What fails is asked once more by curl as another
    attempt, whose pieces alone count then. A body longer than ``limit`` bytes
    fails, without another attempt. any_status: what curl is given counts
    whatever its status, without a content type, so that the bytes tell what it is.
    """
    if url.startswith("data:"):
        meta, _, data = url[5:].partition(",")
        try:
            body = base64.b64decode(data) if meta.endswith(";base64") else unquote_to_bytes(data)
            yield from _pieces(0, _bounded([body], limit), chunk)
            yield _end(0, status=200, final_url=url, content_type=meta.removesuffix(";base64"))
        except (TooLong, ValueError) as e:
            yield _end(0, fail_reason=str(e))
        return
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            size = 0
            for piece in _pieces(0, _bounded(iter(lambda: r.read(chunk), b""), limit), chunk):
                size += len(piece["body"])
                yield piece
            if (said := r.headers.get("content-length") or "").isdigit() and size < int(said):
                raise OSError("Response ended early")
            yield _end(0, status=r.status, final_url=r.url.split("#")[0], content_type=r.headers.get("content-type") or "")
            return
    except TooLong as e:
        yield _end(0, fail_reason=str(e))
        return
    except urllib.error.HTTPError as e:
        why = f"HTTP {e.code}"
    except Exception as e:
        why = str(e)
    if fallback:
        yield from curl(url, headers, timeout, why, any_status=any_status, limit=limit, chunk=chunk)
    else:
        yield _end(1, fail_reason=why)


def _pieces(attempt: int, parts: Iterable[bytes], chunk: int) -> Iterator[dict]:
    n = 0
    for part in parts:
        for at in range(0, len(part), chunk):
            yield {"attempt": attempt, "chunk": n, "body": part[at : at + chunk], "last": False} | dict.fromkeys(_TOLD)
            n += 1


def _end(attempt: int, **told) -> dict:
    return {"attempt": attempt, "chunk": None, "body": None, "last": True} | _TOLD | told


def curl(url: str, headers: dict[str, str], timeout: float, why: str, *, any_status: bool = False, limit: int | None = None, chunk: int = CHUNK) -> Iterator[dict]:
    """The second attempt. What curl says about the response comes by its error stream, so the other one is the body alone."""
    mark = "--folioforge--"
    given = [x for k, v in headers.items() for x in ("-H", f"{k}: {v}")]
    try:
        run = subprocess.Popen(["curl", "-sSL", "--compressed", "--max-time", str(timeout), *given, "-w", f"%{{stderr}}{mark}%{{http_code}}\t%{{url_effective}}\t%{{content_type}}", url], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as e:
        yield _end(1, fetch_method="curl-fallback", fail_reason=f"{why} | curl: {e}")
        return
    said: list[bytes] = []

    def listen() -> None:
        said.append(run.stderr.read(META_LIMIT + 1))
        if len(said[0]) > META_LIMIT:
            run.kill()

    ear, over = threading.Thread(target=listen, daemon=True), None
    ear.start()
    watch = threading.Timer(timeout + 5, run.kill)
    watch.start()
    size = 0
    try:
        for piece in _pieces(1, _bounded(iter(lambda: run.stdout.read(chunk), b""), limit), chunk):
            size += len(piece["body"])
            yield piece
    except TooLong as e:
        over = str(e)
    finally:
        watch.cancel()
        if over:
            run.kill()
        run.stdout.close()
        ear.join()
        run.wait()
    words, _, meta = b"".join(said)[:META_LIMIT].decode("utf-8", "replace").rpartition(mark)
    status, final, kind = (meta.split("\t") + ["", "", ""])[:3]
    status = int(status) if status.isdigit() else 0
    if over or len(said[0]) > META_LIMIT:
        told = {"fail_reason": over or f"What is said of the response is longer than {META_LIMIT} bytes"}
    elif run.returncode == 0 and any_status and size:
        told = {"status": status, "final_url": final.split("#")[0], "content_type": ""}
    elif run.returncode == 0 and 200 <= status < 400:
        told = {"status": status, "final_url": final.split("#")[0], "content_type": kind.strip()}
    else:
        first = words.strip().splitlines()
        told = {"fail_reason": f"{why} | curl: {first[0] if first else f'HTTP {status or chr(63)}'}"}
    yield _end(1, fetch_method="curl-fallback", **told)


def fetch_one(url: str, headers: dict[str, str], timeout: float, fallback: bool = True, *, any_status: bool = False, limit: int | None = None) -> dict:
    """status, final_url, content_type, body, fetch_method and fail_reason of one request; a failure is a row too."""
    held: dict[int, list[bytes]] = {}
    for row in ask(url, headers, timeout, fallback, any_status=any_status, limit=limit):
        if row["last"]:
            told = {k: row[k] for k in _TOLD}
            return told | {"body": b"".join(held.get(row["attempt"], [])) if row["fail_reason"] is None else None}
        held.setdefault(row["attempt"], []).append(row["body"])
    raise AssertionError("ask() ends with a row that is last")


_ARROW = pa.schema([
    ("requested_url", pa.string()), ("fetched_url", pa.string()), ("attempt", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary()), ("last", pa.bool_()),
    ("final_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("fetch_method", pa.string()), ("fail_reason", pa.string()),
])


def _ask_all(rows: Iterable[tuple[str, str, str | None, str]], images: bool, delay: float, limit: int | None, chunk: int, timeout: float | None) -> Iterator[pa.RecordBatch]:
    """The addresses (requested, fetched, why refused, host) of a task one after the other; between two requests to a host pass ``delay`` seconds at least."""
    headers = IMAGE_HEADERS if images else PAGE_HEADERS
    timeout = timeout or (IMAGE_TIMEOUT if images else PAGE_TIMEOUT)
    asked: dict[str, float] = {}
    for requested, fetched, refused, host in rows:
        if refused is not None:
            answer = iter([_end(0, fetch_method=None, content_type=None, fail_reason=refused)])
        else:
            wait = asked.get(host, 0.0) + delay - time.monotonic() if host in asked else 0.0
            if wait > 0:
                time.sleep(wait)
            answer = ask(fetched, headers, timeout, any_status=images, limit=limit, chunk=chunk)
        for row in answer:
            yield pa.RecordBatch.from_pylist([{"requested_url": requested, "fetched_url": fetched} | row], schema=_ARROW)
        if delay:
            asked[host] = time.monotonic()


def _partitions(frame: DataFrame) -> int:
    """Partitions that hosts are dealt to, if nothing else is said."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def addresses(urls: DataFrame, url: str = "url", *, images: bool = False) -> DataFrame:
    """The different addresses of a column: requested_url, fetched_url, refused (why, else null), host, and turn, an address's place among those of its host."""
    asked = urls.select(F.col(url).alias("requested_url")).where("requested_url is not null").distinct()
    checked = asked.withColumn("_c", F.coalesce(canonical("requested_url"), "requested_url")).withColumn("refused", validation_error("_c") if not images else F.lit(None).cast("string"))
    checked = checked.select("requested_url", (F.col("_c") if images else upgraded("_c")).alias("fetched_url"), "refused")
    checked = checked.withColumn("host", F.when(F.col("fetched_url").startswith("data:"), F.lit("")).otherwise(raw_host("fetched_url")))
    return checked.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("requested_url")))


def fetch_chunks(urls: DataFrame, url: str = "url", *, images: bool = False, delay: float = 0.0, limit: int | None = None, chunk: int = CHUNK, hosts: int | None = None, timeout: float | None = None) -> DataFrame:
    """Responses to the different addresses of a column, piece by piece (CHUNKS). Refused addresses and failed requests are rows with a reason.

    All addresses of a host are in one partition and asked one after the other,
    so no host is asked twice at once; a task takes its hosts by turns. delay:
    seconds between requests to one host; limit: most bytes of a body (images:
    30 MiB unless told otherwise).
    """
    limit = limit if limit is not None or not images else IMAGE_LIMIT
    by_host = addresses(urls, url, images=images).repartition(hosts or _partitions(urls), "host").sortWithinPartitions("turn", "host")

    # a task has one clock for each host: its batches come to one call of run
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("requested_url", "fetched_url", "refused", "host"))))
        yield from _ask_all(rows, images, delay, limit, chunk, timeout)

    return by_host.mapInArrow(whole, CHUNKS)


def fetch(urls: DataFrame, url: str = "url", *, images: bool = False, **options) -> DataFrame:
    """Responses (SOURCES) with whole bodies, asked for and stored at once; options are those of fetch_chunks()."""
    return assembled(stored(fetch_chunks(urls, url, images=images, **options)), every=True).select(*[c.split()[0] for c in SOURCES.split(", ")])


def image_bytes(images: DataFrame, **options) -> DataFrame:
    """image_url, body, content_type and fail_reason of the different image_url of a table, each fetched once."""
    return fetch(images, "image_url", images=True, **options).select(F.col("requested_url").alias("image_url"), "body", "content_type", "fail_reason")


FORMAT = "folioforge_http"


def save_addresses(urls: DataFrame, path: str, url: str = "url", *, images: bool = False, hosts: int | None = None) -> None:
    """The different addresses of a column as a folder that the source reads: each host in one folder hosts=N, its addresses in turn."""
    hosts = hosts or _partitions(urls)
    dealt = addresses(urls, url, images=images).withColumn("hosts", F.pmod(F.xxhash64("host"), F.lit(hosts)))
    dealt.repartition(hosts, "hosts").sortWithinPartitions("hosts", "turn", "host").write.mode("overwrite").partitionBy("hosts").parquet(path)


class Responses(DataSource):
    """spark.read.format("folioforge_http").load(folder): the responses (CHUNKS) to what save_addresses() has put there.

    One partition for each folder of hosts, so no host is asked by two tasks at
    once. Options: delay (seconds between requests to a host), limit (most bytes
    of a body), chunk (bytes of one row), timeout (seconds), images (true or false).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> ResponsesReader:
        return ResponsesReader(dict(self.options))


class HostFolder(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ResponsesReader(DataSourceReader):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.path, self.images = get("path"), get("images", "false").lower() == "true"
        self.delay, self.chunk = float(get("delay", 0)), int(get("chunk", CHUNK))
        self.limit = int(limit) if (limit := get("limit")) else IMAGE_LIMIT if self.images else None
        self.timeout = float(timeout) if (timeout := get("timeout")) else None

    def partitions(self) -> list[HostFolder]:
        return [HostFolder(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if re.fullmatch(r"hosts=\d+", n)]

    def read(self, partition: HostFolder) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for name in sorted(n for n in os.listdir(partition.path) if n.endswith(".parquet")):
                for batch in pq.ParquetFile(os.path.join(partition.path, name)).iter_batches(256, columns=["requested_url", "fetched_url", "refused", "host"]):
                    yield from zip(*(batch.column(c).to_pylist() for c in ("requested_url", "fetched_url", "refused", "host")))

        yield from _ask_all(rows(), self.images, self.delay, self.limit, self.chunk, self.timeout)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Responses)
