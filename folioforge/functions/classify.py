"""What a response is: by its header, else by its extension, else by its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import col, let, trim_start
from folioforge.functions.urls import content_type_base, extension

FIELDS = ("kind", "subtype", "language", "render", "extension")
SCHEMA = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"

# Content types, extensions and magic numbers with what they stand for.
GENERIC_TYPES = ["", "application/octet-stream", "binary/octet-stream"]
TYPE_EXTENSIONS = {
    "application/pdf": ".pdf", "application/zip": ".zip", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif",
    "image/webp": ".webp", "image/svg+xml": ".svg", "image/avif": ".avif",
}
ARCHIVE_EXTENSIONS = {
    "application/gzip": ".gz", "application/x-tar": ".tar",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
}
MAGIC = [("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif")]
SAMPLE = 4096


def _class(kind, subtype, language, render, extension_) -> Column:
    values = [v if isinstance(v, Column) else F.lit(v).cast("string") for v in (kind, subtype, language, render, extension_)]
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS)])


def _text(subtype, language=None, render="fenced", extension_=".txt") -> Column:
    return _class("text", subtype, subtype if language is None else language, render, extension_)


def _html() -> Column:
    return _class("html", "html", "html", "html", ".html")


def _asset(subtype, extension_) -> Column:
    return _class("asset", subtype, "", "asset", extension_)


def _plain() -> Column:
    return _text("plain", "", "direct", ".txt")


def _markdown() -> Column:
    return _text("markdown", "markdown", "direct", ".md")


def _lookup(value: Column, table: dict[str, str]) -> Column:
    out = None
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out


def by_header(base: Column) -> Column:
    """Null for types that are not text."""
    rest = F.substring(base, 6, 1000)
    return (
        F.when(base.isin("text/html", "application/xhtml+xml"), _html())
        .when(base == "text/markdown", _markdown())
        .when(base == "text/plain", _plain())
        .when((base == "application/json") | F.endswith(base, F.lit("+json")), _text("json", extension_=".json"))
        .when((base == "application/xml") | F.endswith(base, F.lit("+xml")), _text("xml", extension_=".xml"))
        .when(base.isin("application/javascript", "text/javascript"), _text("javascript", extension_=".js"))
        .when(base == "application/x-www-form-urlencoded", _text("form", "text"))
        .when(base == "text/css", _text("css", extension_=".css"))
        .when(base == "text/csv", _text("csv", extension_=".csv"))
        .when(F.startswith(base, F.lit("text/")), _text(rest, rest))
    )


def by_extension(ext: Column) -> Column:
    return (
        F.when(ext.isin(".html", ".htm"), _html())
        .when(ext.isin(".md", ".markdown"), _markdown())
        .when(ext == ".txt", _plain())
        .when(ext == ".json", _text("json", extension_=".json"))
        .when(ext.isin(".xml", ".rss", ".atom"), _text("xml", extension_=".xml"))
        .when(ext.isin(".js", ".mjs", ".cjs"), _text("javascript", extension_=".js"))
        .when(ext == ".css", _text("css", extension_=".css"))
        .when(ext == ".csv", _text("csv", extension_=".csv"))
        .when(ext.isin(".yaml", ".yml"), _text("yaml", extension_=".yaml"))
        .when(ext == ".pdf", _asset("application/pdf", ".pdf"))
        .when(ext.isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".zip", ".docx", ".pptx", ".xlsx"), _asset("binary", ext))
    )


def is_text(sample: Column) -> Column:
    """UTF-8 without NUL and control characters; a character cut off at the end spoils it."""
    return F.is_valid_utf8(sample.cast("string")) & ~sample.cast("string").rlike(r"[\x00-\x08\x0E-\x1F]")


def by_bytes(body: Column) -> Column:
    sample = F.substring(body, 1, SAMPLE)
    head = F.hex(F.substring(sample, 1, 16))
    text = F.lower(trim_start(sample.cast("string")))
    return (
        F.when(head.startswith("255044462D"), _asset("application/pdf", ".pdf"))
        .when(head.startswith("89504E470D0A1A0A"), _asset("image/png", ".png"))
        .when(head.startswith("FFD8FF"), _asset("image/jpeg", ".jpg"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), _asset("image/gif", ".gif"))
        .when(head.rlike("^52494646.{8}57454250"), _asset("image/webp", ".webp"))
        .when(head.startswith("504B"), _asset("application/zip", ".zip"))
        .when(is_text(sample), F.when(text.startswith("<!doctype html") | text.startswith("<html"), _html()).otherwise(_plain()))
        .otherwise(_asset("binary", ".bin"))
    )


def extension_of_type(content_type) -> Column:
    return _lookup(content_type_base(content_type), TYPE_EXTENSIONS)


def classify(content_type, url, body) -> Column:
    def known(base: Column, ext: Column) -> Column:
        kept = F.coalesce(_lookup(base, ARCHIVE_EXTENSIONS), _lookup(base, TYPE_EXTENSIONS), ext, F.lit(".bin"))
        return F.when(base.isin(GENERIC_TYPES), F.coalesce(by_extension(ext), by_bytes(col(body)))).otherwise(F.coalesce(by_header(base), _asset(base, kept)))

    return let(content_type_base(content_type), lambda base: let(extension(url), lambda ext: known(base, ext)))


def image_format(body) -> Column:
    """png, jpeg, gif, webp, heif or svg; null for anything else."""
    head = F.hex(F.substring(col(body), 1, 16))
    text = F.lower(trim_start(F.substring(col(body), 1, 256).cast("string")))
    return F.when(F.length(col(body)) >= 12, (
        F.when(head.startswith("89504E470D0A1A0A"), F.lit("png"))
        .when(head.startswith("FFD8FF"), F.lit("jpeg"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("gif"))
        .when(head.rlike("^52494646.{8}57454250"), F.lit("webp"))
        .when(head.rlike("^.{8}66747970"), F.lit("heif"))
        .when(text.startswith("<svg") | (text.startswith("<?xml") & F.contains(text, F.lit("<svg"))), F.lit("svg"))
    ))


def _number(body: Column, at: int, order: list[int]) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(body, at + k, 1)) for k in order]), 16, 10).cast("int")


def _be16(body: Column, at) -> Column:
    return F.conv(F.hex(F.substring(body, at, 2)), 16, 10).cast("int")


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


#: Segments of a JPEG that are walked at most; a size behind more of them counts as unknown.
SEGMENTS = 512


def _jpeg_size(body: Column) -> Column:
    """Height and width stand in the frame header; what comes before it is skipped segment by segment, by the length that each tells."""
    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        head = F.hex(F.substring(body, at, 2))
        moved = lambda to: F.struct(to.cast("int").alias("at"), state["width"].alias("width"), state["height"].alias("height"))
        frame = F.struct(F.lit(0).alias("at"), _be16(body, at + 7).alias("width"), _be16(body, at + 5).alias("height"))
        return (
            F.when((at == 0) | ~head.startswith("FF") | (F.length(head) < 4), moved(F.lit(0)))
            .when(head == "FFFF", moved(at + 1))  # a byte that fills up
            .when(head.rlike("^FF(01|D[0-7])"), moved(at + 2))  # a marker without a segment
            .when(head.rlike("^FFC[0-35-79-BD-F]"), frame)
            .when(head.rlike("^FFD[89A]"), moved(F.lit(0)))  # the picture begins, or ends
            .otherwise(moved(at + 2 + F.greatest(F.coalesce(_be16(body, at + 2), F.lit(2)), F.lit(2))))
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)
    return let(found, lambda f: F.when((f["width"] > 0) & (f["height"] > 0), _size(f["width"], f["height"])))


def _webp_size(body: Column) -> Column:
    """Lossy, lossless and extended files keep their size in three ways."""
    byte = lambda at: _number(body, at, [0])
    kind = F.hex(F.substring(body, 13, 4))
    lossy = _size(_number(body, 27, [1, 0]).bitwiseAND(0x3FFF), _number(body, 29, [1, 0]).bitwiseAND(0x3FFF))
    lossless = _size(
        1 + byte(22) + F.shiftleft(byte(23).bitwiseAND(0x3F), 8),
        1 + F.shiftright(byte(23), 6) + F.shiftleft(byte(24), 2) + F.shiftleft(byte(25).bitwiseAND(0x0F), 10),
    )
    extended = _size(1 + _number(body, 25, [2, 1, 0]), 1 + _number(body, 28, [2, 1, 0]))
    return (
        F.when((kind == "56503820") & (F.hex(F.substring(body, 24, 3)) == "9D012A") & (F.length(body) >= 30), lossy)
        .when((kind == "5650384C") & (byte(21) == 0x2F) & (F.length(body) >= 25), lossless)
        .when((kind == "56503858") & (F.length(body) >= 30), extended)
    )


def _svg_size(body: Column) -> Column:
    """Width and height of the drawing's own tag, in pixels, else the size of its view box; other units count as unknown."""
    tag = F.regexp_extract(F.substring(body, 1, SAMPLE).cast("string"), r"(?is)<svg\b([^>]*)>", 1)
    number = r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
    length = lambda name: F.nullif(F.regexp_extract(tag, rf"(?is)(?:\A|\s){name}\s*=\s*[\"']\s*\+?{number}(?:px)?\s*[\"']", 1), F.lit("")).cast("double")
    told = lambda name: tag.rlike(rf"(?is)(?:\A|\s){name}\s*=\s*[\"']\s*[^\"'%]*[\"']")
    box = lambda k: F.nullif(F.regexp_extract(tag, rf"(?is)(?:\A|\s)viewBox\s*=\s*[\"']\s*-?[0-9.]+[\s,]+-?[0-9.]+[\s,]+{number}[\s,]+{number}\s*[\"']", k), F.lit("")).cast("double")
    side = lambda name, k: F.round(F.when(told(name), length(name)).otherwise(box(k)))
    return let(F.struct(side("width", 1).alias("w"), side("height", 2).alias("h")), lambda x: F.when((x["w"] > 0) & (x["h"] > 0), _size(x["w"], x["h"])))


def image_size(body) -> Column:
    """Width and height from the headers of PNG, GIF, JPEG and WEBP images and the tag of SVG drawings; null for others, whose images are kept."""
    b = col(body)
    return let(image_format(b), lambda form: (
        F.when((form == "png") & (F.length(b) >= 24), _size(_number(b, 17, [0, 1, 2, 3]), _number(b, 21, [0, 1, 2, 3])))
        .when(form == "gif", _size(_number(b, 7, [1, 0]), _number(b, 9, [1, 0])))
        .when(form == "jpeg", _jpeg_size(b))
        .when(form == "webp", _webp_size(b))
        .when(form == "svg", _svg_size(b))
    ))


def tiny(width, height) -> Column:
    return (F.least(col(width), col(height)) < 24) | (F.greatest(col(width), col(height)) <= 64)
