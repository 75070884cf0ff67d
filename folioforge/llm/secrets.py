"""Secret scans: patterns first, then decoded candidates whose structure confirms them."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import arrow_map, table
from folioforge.llm.spans import Span, counts, digest, joined, ordered, replaced

BASE_KINDS = ("assign", "access", "hex")
#: Found by structure: signed tokens, armoured keys, bare DER keys, OpenSSH keys.
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "openssh")

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: base64 of an opening brace, alone or before a space or line break, starts with one of these.
_BRACES = ("eyJ", "eyA", "ewo", "ew0", "ewk", "e30", "eyI")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e[yw3][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(.*?)-----END \1-----", re.DOTALL)
_PEM_HEADER = re.compile(r"(?m)^[A-Za-z0-9-]+:.*(?:\n[ \t].*)*$")
#: Candidates for decoding, the least length that holds a key: 40 characters of base64 (30 bytes), also over several
#: lines of at least that length but the last; 64 of hex (32 bytes).
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]{40,})*\r?\n[A-Za-z0-9+/_-]+={0,2}(?![A-Za-z0-9+/_=-])")
_LONG_HEX = re.compile(r"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{2}){32,}(?![0-9a-fA-F])")


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out, KINDS)


def _unbase64(text: str) -> bytes | None:
    # line breaks may be spelled out, as in JSON; the URL-safe alphabet counts as well
    body = re.sub(r"\s|\\[rn]", "", text)
    body = body.replace("-", "+").replace("_", "/").rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """Where the DER element at ``at`` ends, if it and all that it nests have sound tags and lengths."""
    if depth > 12 or at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if tag & 0x1F == 0x1F or tag == 0:
        return None
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or data[at] == 0:  # DER has one way to write a length
            return None
        at += n
    stop = at + size
    if stop > end or (tag == 0x02 and not size):
        return None
    if tag & 0x20:
        while at < stop:
            nxt = der_length(data, at, stop, depth + 1)
            if nxt is None:
                return None
            at = nxt
    return stop


def is_der_key(data: bytes) -> bool:
    """A DER sequence over all the data that starts with a version number, as private keys do."""
    if len(data) < 32 or data[0] != 0x30 or der_length(data, 0, len(data)) != len(data):
        return False
    body = 2 + (data[1] & 0x7F if data[1] >= 0x80 else 0)
    return data[body : body + 2] == b"\x02\x01" and data[body + 2] in (0, 1, 2, 3)


def is_openssh_key(data: bytes) -> bool:
    """The magic of an OpenSSH private key, then strings whose lengths fit."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation and its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_signed_token(token: str) -> bool:
    """Three parts; the first is base64 of a JSON object that names its algorithm, the second of a JSON object."""
    parts = token.split(".")
    if len(parts) != 3:
        return False
    try:
        head, body = (json.loads(_unbase64(p) or b"0") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _decoded_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    if is_openssh_key(data):
        return "openssh"
    if is_der_key(data):
        return "der"
    if data.startswith(b"-----BEGIN ") and b"PRIVATE KEY-----" in data[:64]:
        return "pem"
    return "jwt" if data[:3].decode("ascii", "replace") in _BRACES and is_signed_token(data.decode("ascii", "replace").strip()) else None


def confirmed_spans(text: str) -> list[Span]:
    """Candidates that decode to the structure of a key or a signed token."""
    out: list[Span] = []
    if any(b in text for b in _BRACES):
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\r?\\n|\r\n|\\n", "\n", m[2])
            data = _unbase64(_PEM_HEADER.sub("", body))
            if data and (is_der_key(data) or is_openssh_key(data) or "ENCRYPTED" in m[1] + m[2]):
                out.append(("pem", *m.span()))
    whole: list[tuple[int, int]] = []
    for m in _LINES.finditer(text):
        if kind := _decoded_kind(_unbase64(m[0])):
            out.append((kind, *m.span()))
            whole.append(m.span())
    for m in _BASE64.finditer(text):
        if kind := _decoded_kind(_unbase64(m[0])):
            out.append((kind, *m.span()))
    for m in _LONG_HEX.finditer(text):
        if kind := _decoded_kind(bytes.fromhex(m[0])):
            out.append((kind, *m.span()))
    return uncovered(out, [(a, b) for k, a, b in out if k == "pem"] + whole)


def uncovered(spans: list[Span], around: list[tuple[int, int]]) -> list[Span]:
    """Spans that no other place holds. By start, the furthest end so far tells: as many steps as there are spans, once sorted."""
    if not around:
        return spans
    places, kept, at, furthest = sorted(set(around), key=lambda p: (p[0], -p[1])), [], 0, -1
    for s in sorted(spans, key=lambda s: (s[1], -s[2])):
        while at < len(places) and (places[at][0] < s[1] or (places[at][0] == s[1] and places[at][1] > s[2])):
            furthest = max(furthest, places[at][1])
            at += 1
        if furthest < s[2]:
            kept.append(s)
    return kept


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    return base, ordered(base + confirmed_spans(text), KINDS)


def scan(docs: DataFrame) -> DataFrame:
    """Columns of docs, plus secrets: an array of kind, start and end (code points, end exclusive).

    A null text counts as empty and texts of any length are read whole. Each
    row is judged alone; repeated rows, null ids and other columns pass through;
    a column named secrets is replaced. An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c != "secrets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t or "")[1]] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, kind)], names=[*keep, "secrets"])

    docs = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, secrets array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Docs with each secret in text replaced by a mark.

    Null and empty texts stay as they are, texts of any length are read whole,
    each of several repeated rows is redacted, other columns pass through, and
    an empty table gives an empty one.
    """

    columns = docs.columns
    at = columns.index("text")

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else replaced(t, s, mark) if (s := find(t)[1]) else t for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))], names=columns)

    return arrow_map(docs, typed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t or "") for t in batch.column("text").to_pylist()]
        n = [counts(base) for base, _ in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([c[k] for c in n], pa.int64()) for k in BASE_KINDS), pa.array([digest(b) for b, _ in found]), pa.array([joined(a) for _, a in found])],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
        )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of secrets in all documents. Null texts count as empty; repeated rows each stay; long texts count whole; no rows give none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return arrow_map(docs, _digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
