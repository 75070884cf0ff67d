"""Bundles of captures that keep arriving: state by address and by bundle, and what each batch reads."""

import random
from datetime import datetime, timedelta

import pytest

from folioforge.sources.captures import SOURCES
from folioforge.streaming import captures
from folioforge.streaming.keyed import touched

SCHEMA = SOURCES + ", role string, bundle_id long, ingested timestamp"
IMAGES = "image_url string, body binary, content_type string, fail_reason string"
BASE = "https://late.example.com"


def page(*links):
    return "<html><body><article><h1>Page</h1><p>" + "".join(f'<a href="{BASE}/{x}">{x}</a> ' for x in links) + "</p></article></body></html>"


def row(name, html, minute, role="reference", bundle=None, why=None):
    url = f"{BASE}/{name}"
    return (url, url, None if why else url, None if why else 200, "text/html", html.encode() if html is not None else None, "fetch", why, role, bundle, None if minute is None else datetime(2024, 1, 1) + timedelta(minutes=minute))


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stop(spark):
    for q in spark.streams.active:
        q.stop()


@pytest.fixture
def few_partitions(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    stop(spark)
    spark.conf.set("spark.sql.shuffle.partitions", had)


ARRIVALS = [
    [row("a", page("b", "c#part", "d"), 0, "main", 1), row("x", page("b"), 0, "main", 2), row("d", None, 0, why="HTTP 500")],
    [row("b", "<h1>Late</h1>", 1), row("other", "<h1>Nobody asks</h1>", 1)],
    [row("c#part", "<h1>Third</h1>", 2), row("d", "<h1>Mended</h1>", 2), row("y", page("other", "b"), 2, "main", 3)],
    [row("d", None, 3, why="HTTP 404"), row("b", "<h1>Later still</h1>", 4), row("b", "<h1>Earlier</h1>", -1), row("a", page("b", "e"), 4, "main", 1)],
]


def test_as_in_one_batch(spark, tmp_path, few_partitions):
    """Whatever the order of arrival, the last state is that of one batch with all rows; nothing stays in the shared folder."""
    import os

    from folioforge.storage import shared_folder

    images = spark.createDataFrame([], IMAGES)
    ran = {}
    for name, batches in (("steps", ARRIVALS), ("once", [[r for b in ARRIVALS for r in b]])):
        for k, rows in enumerate(batches):
            land(spark, tmp_path / name / "in dir", rows)
            stream = captures.read_stream(spark, str(tmp_path / name / "in dir"), schema=SCHEMA)
            captures.write_bundles(stream, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state", images, salts=2).processAllAvailable()
            stop(spark)
        ran[name] = {t: sorted(map(repr, captures.newest(spark, f"{tmp_path}/{name}/out", t).collect())) for t in ("outcomes", "link_map", "manifest", "rendered", "files", "asset_outcomes")}
    assert ran["steps"] == ran["once"] and len(ran["once"]["manifest"]) == 3
    titles = {r.link_url: (r.kind, r.title) for r in captures.newest(spark, f"{tmp_path}/steps/out", "outcomes").where("bundle_id = 1").collect()}
    assert titles == {f"{BASE}/b": ("readable", "Later still"), f"{BASE}/e": ("failed", "e")}
    made = {(r.batch, r.bundle_id) for r in spark.read.parquet(f"{tmp_path}/steps/out/made").collect()}
    assert made == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3)}
    folder = f"{shared_folder(spark)}/bundles-{spark.sparkContext.applicationId}"
    assert not os.path.isdir(folder) or not any(f for f in os.listdir(folder) if os.path.getmtime(f"{folder}/{f}") > os.path.getmtime(f"{tmp_path}/steps/in dir"))


def test_batches_read_what_they_touch(spark, tmp_path, few_partitions):
    """Twenty batches: each lists its own file and those of the bundles it touches, however many came before."""
    read, told = [], []

    def one(batch, k):
        rows = batch.persist()
        told.append(sorted({(r.bundle_id, r.address) for r in rows.collect()}))
        files = captures.answers(spark, rows, stream.schema).inputFiles() if rows.head(1) else []
        read.append(len(files))

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(20):
            # bundle k links to what came one batch ago, to what comes with the next, and to what never comes
            land(spark, tmp_path / "in", [row(f"m{k}", page(f"r{k - 1}", f"r{k + 1}", f"never{k}"), k, "main", k), row(f"r{k}", f"<h1>{k}</h1>", k)])
        stream = captures.read_stream(spark, f"{tmp_path}/in", 1, schema=SCHEMA)
        query = touched(captures.located(stream), 2).writeStream.foreachBatch(one).option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(read) == 20 and read == [1] + [2] + [3] * 18
    assert all(sorted({b for b, _ in t}) == ([k - 1, k] if k else [0]) for k, t in enumerate(told))


def test_popular_address_and_odd_rows(spark, tmp_path, few_partitions):
    """Three thousand bundles wait for one address; rows without an address, a time, a body or a bundle say what they can."""
    odd = [row("m", page("p"), None, "main", None), row("n", None, 1, "main", 5), (None,) * 11]
    land(spark, tmp_path / "in", [row(f"m{k}", page("p"), 0, "main", k) for k in range(100, 3100)] + odd)
    seen = {}

    def one(batch, k):
        seen[k] = {(r.bundle_id, r.address.rsplit("/", 1)[1]) for r in batch.collect()}

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = captures.read_stream(spark, f"{tmp_path}/in", schema=SCHEMA)
        query = touched(captures.located(stream)).writeStream.foreachBatch(one).option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        land(spark, tmp_path / "in", [row("p", "<h1>P</h1>", 3)])
        query.processAllAvailable()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen[0] == {(k, f"m{k}") for k in range(100, 3100)} | {(5, "n")}
    assert seen[1] == {(k, x) for k in range(100, 3100) for x in (f"m{k}", "p")}
