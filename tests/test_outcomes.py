"""Popular addresses, names that two bases claim, and sizes of images."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from folioforge.functions import classify
from folioforge.operators import assets
from folioforge.operators.joins import join_popular
from folioforge.operators.names import allocate_names


def by_fold(bases):
    """In link order, the first free of base, base-2, base-3 and so on."""
    used, next_, names = set(), {}, []
    for base in bases:
        name, k = f"references/{base}.md", next_.get(base, 2)
        while name in used:
            name, k = f"references/{base}-{k}.md", k + 1
        next_[base] = k
        used.add(name)
        names.append(name)
    return names


def test_names_equal_the_fold(spark):
    draw = random.Random(7)
    bundles = []
    for b in range(400):
        pool = [f"a{x}{y}" for x in ("", "-2", "-3", "-5", "-02", "-1") for y in ("", "-2", "-2-2", "-3", "-12")] + ["a-2-2-2", "a-2-2-3", "b", "b-2"]
        pool = draw.sample(pool, draw.randrange(1, len(pool))) + ["a"]
        bundles.append([draw.choice(pool) if draw.random() < 0.7 else draw.choice(pool[-2:]) for _ in range(draw.randrange(40))])
    rows = [(b, p, t) for b, titles in enumerate(bundles) for p, t in enumerate(titles)]
    draw.shuffle(rows)
    got = {(r.bundle_id, r.pos): r.relative_path for r in allocate_names(spark.createDataFrame(rows, "bundle_id long, pos int, title string")).collect()}
    assert got == {(b, p): n for b, titles in enumerate(bundles) for p, n in enumerate(by_fold(titles))}


def test_names_of_one_giant_bundle(spark):
    """A million references, half of them with one title, all in one bundle with clashes; no Python takes part."""
    n = 1_000_000
    title = F.when(F.col("id") % 2 == 0, F.lit("page")).otherwise(F.concat(F.lit("page-"), (F.col("id") * 7919 % 5000).cast("string"), F.when(F.col("id") % 9 == 0, F.lit("-2")).otherwise(F.lit(""))))
    frame = spark.range(n).select(F.lit(1).cast("long").alias("bundle_id"), F.col("id").cast("int").alias("pos"), title.alias("title"))
    made = allocate_names(frame)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    rows = made.collect()
    titles = [r.title for r in frame.orderBy("pos").collect()]
    assert {r.pos: r.relative_path for r in rows} == dict(enumerate(by_fold(titles))) and len({r.relative_path for r in rows}) == n


def test_popular_address(spark):
    """One address has half of all links: without adaptive execution, the largest task has at most twice the rows of the median one."""
    had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(had, ("false", "-1", "8")):
        spark.conf.set(k, v)
    try:
        n = 40_000
        links = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.lit("https://popular.example.com/")).otherwise(F.concat(F.lit("https://x.example.com/"), F.col("id"))).alias("link_url"))
        links = links.unionByName(spark.createDataFrame([(n + k, None) for k in range(3000)], "id long, link_url string")).cache()
        sources = links.where("link_url is not null and id % 10 < 5").select("link_url").distinct().withColumn("title", F.upper("link_url"))
        for how in ("left", "inner"):
            joined = join_popular(links, sources, "link_url", ["id"], how)
            tasks = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("t")).count().collect())
            assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4], tasks
            plain = links.join(sources, "link_url", how)
            assert joined.columns == plain.columns and joined.exceptAll(plain).count() == plain.exceptAll(joined).count() == 0
        assert join_popular(links.limit(0), sources, "link_url", ["id"]).count() == 0
        plain = links.join(sources, "link_url").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert plain > n / 2
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def segment(marker, data):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data


def jpeg(width, height, frame=0xC0, before=()):
    return b"\xff\xd8" + b"".join(before) + segment(frame, b"\x08" + struct.pack(">HH", height, width) + b"\x03" + b"\0" * 9) + b"\xff\xda" + b"\0" * 600


def webp(kind, data):
    return b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(data)) + data + b"\0" * 600


SIZES = [
    (jpeg(640, 480), (640, 480)),
    (jpeg(16, 16, 0xC2, [segment(0xE0, b"JFIF\0" + b"\0" * 9), b"\xff\xff", segment(0xE1, b"x" * 60_000), segment(0xC4, b"\xff\xc0" * 9)]), (16, 16)),
    (jpeg(30_000, 1, 0xC9, [segment(0xE2, b"p" * 65_000)] * 5 + [b"\xff\x01"]), (30_000, 1)),
    (b"\xff\xd8" + segment(0xE0, b"x") + b"\xff\xda" + b"\0" * 600, None), (b"\xff\xd8\xff\xe0\xff\xff" + b"\0" * 20, None), (b"\xff\xd8" + segment(0xE0, b"") * 700 + jpeg(5, 5)[2:], None),
    (webp(b"VP8 ", b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 321, 200)), (321, 200)), (webp(b"VP8 ", b"\x10\0\0\0\0\0" + b"\1\0\1\0"), None),
    (webp(b"VP8L", b"\x2f" + struct.pack("<I", (100 - 1) | (17 - 1) << 14)), (100, 17)), (webp(b"VP8L", b"\x2f" + struct.pack("<I", 16383 | 16383 << 14)), (16384, 16384)),
    (webp(b"VP8X", b"\0\0\0\0" + (70_000 - 1).to_bytes(3, "little") + (24 - 1).to_bytes(3, "little")), (70_000, 24)),
    (b'<svg xmlns="x" width="20" height="16.4px">', (20, 16)), (b"<?xml version='1.0'?>\n<svg viewBox='0 0 300 150.5'>", (300, 151)), (b'<svg width="100%" height="100%" viewBox="0,0,24,24"/>', (24, 24)),
    (b'<svg width="3em" height="2cm" viewBox="0 0 9 9">', None), (b"<svg>           ", None), (b'<svg stroke-width="2" viewBox="0 0 9 8">', (9, 8)),
]


def test_sizes(spark):
    frame = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(SIZES)], "k int, b binary")
    got = {r.k: (r.s.width, r.s.height) if r.s else None for r in frame.select("k", classify.image_size("b").alias("s")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(SIZES)}


@pytest.mark.parametrize(("body", "why"), [(jpeg(16, 16), "tiny_dimensions"), (jpeg(65, 24), None), (jpeg(64, 64), "tiny_dimensions"), (webp(b"VP8X", b"\0" * 4 + b"\x3f\0\0\x3f\0\0"), "tiny_dimensions"), (b"<svg width='16' height='16'>" + b" " * 600, "tiny_dimensions"), (b"<svg>" + b" " * 600, None)])
def test_small_icons_are_dropped(spark, body, why):
    frame = spark.createDataFrame([(bytearray(body), None)], "body binary, fail_reason string")
    assert frame.select(assets.verdict().alias("v")).first().v == why


def outcome(bundle, pos, kind, **more):
    row = {"bundle_id": bundle, "pos": pos, "link_url": f"https://a.example.com/{pos}", "link_label": None, "kind": kind, "title": f"T \u00e9 \"{pos}\" \n", "relative_path": f"references/r-{pos}.md", "asset_path": None}
    row |= {c: f"https://a.example.com/{pos}" for c in ("requested_url", "fetched_url", "final_url")} | {"content_type": "text/html", "cls_kind": "html", "skipped_reason": None, "fail_reason": None}
    if kind == "skipped":
        row |= {"relative_path": None, "skipped_reason": "low_signal_marketing_reference", "link_label": "l\u00e4bel"}
    return tuple((row | more).values())


OUTCOMES = "bundle_id long, pos int, link_url string, link_label string, kind string, title string, relative_path string, asset_path string, requested_url string, fetched_url string, final_url string, content_type string, cls_kind string, skipped_reason string, fail_reason string"


@pytest.mark.parametrize("places", [1, 3, 4096])
def test_manifest_in_parts(spark, tmp_path, places):
    """Parts put together by the sink are the bytes of the whole, for bundles of entries, of skipped ones, of both and of none."""
    from folioforge.operators.outcomes import manifest_files, manifests
    from folioforge.sources.files import write_files
    from folioforge.sources.sinks import pretty_manifest

    rows = [outcome(1, k, "readable") for k in range(7)] + [outcome(1, 7, "alias", relative_path="references/r-2.md"), outcome(1, 8, "skipped"), outcome(1, 9, "failed", fail_reason="HTTP 404")]
    rows += [outcome(2, k, "skipped") for k in range(5)] + [outcome(3, 4, "asset", asset_path="references/assets/r-4.bin")]
    told, bundles = spark.createDataFrame(rows, OUTCOMES), spark.createDataFrame([(k,) for k in range(1, 5)], "bundle_id long")
    parts = manifest_files(told, bundles, places)
    write_files(parts.select("bundle_id", F.lit("m.json").alias("relative_path"), "chunk", F.col("text").cast("binary").alias("body")), str(tmp_path))
    want = {r.bundle_id: pretty_manifest(r.json) for r in manifests(told, bundles).collect()}
    assert {b: (tmp_path / str(b) / "m.json").read_text() for b in want} == want and want[4] == "{}\n"


def test_manifest_of_a_giant_bundle(spark):
    """A hundred thousand references with long titles in one bundle: no row is longer than 16 MB."""
    from folioforge.operators.outcomes import manifest_files

    one = spark.createDataFrame([outcome(1, 0, "readable")], OUTCOMES)
    many = one.drop("pos", "title", "relative_path", "kind").crossJoin(spark.range(100_000)).select(
        *[c for c in one.columns if c not in ("pos", "title", "relative_path", "kind")], F.col("id").cast("int").alias("pos"), F.repeat(F.lit("t"), 1000).alias("title"),
        F.concat(F.lit("references/"), "id", F.lit(".md")).alias("relative_path"), F.when(F.col("id") % 3 == 0, "skipped").otherwise("readable").alias("kind"),
    )
    got = manifest_files(many, one.select("bundle_id")).agg(F.max(F.octet_length("text")).alias("most"), F.sum(F.octet_length("text")).alias("all"), F.count("*").alias("n")).first()
    assert got["most"] < 16 << 20 and got["all"] > 100 << 20 and got["n"] == 50


def test_source_names(spark):
    from folioforge.operators.names import source_name

    assert [r.s for r in spark.createDataFrame([(0,), (98,), (998,), (999,), (12_344,)], "pos int").select(source_name("pos").alias("s")).collect()] == [f"reference-{n}.source" for n in ("001", "099", "999", "1000", "12345")]
