"""Personal data: patterns seed a bootstrapped extraction by context."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, stash, table, unstash
from folioforge.llm.spans import Span, counts, digest, joined, merged, ordered

BASE_KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: What an unseen identifier may look like: at least five characters with three digits or an at sign, or digits in
#: groups between single spaces, seven at least.
_CANDIDATE = re.compile(r"(?<!\S)(?=\S*@|(?:\S*?[0-9]){3})\S{5,}")
_GROUPS = re.compile(r"(?<!\S)[+(]?[0-9][0-9().+-]*(?:\x20[(]?[0-9][0-9().-]*)+(?!\S)")
_HAS_DIGITS = re.compile(r"[0-9]\S*[0-9]\S*[0-9]|[0-9]\x20[0-9]")
_EDGE = ".,;:!?\"'()[]{}<>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Around each at sign: the run of local characters before it, back to the last match at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping for each kind; matches that fail their check go."""
    out: list[Span] = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return ordered(out, BASE_KINDS)


def _normal(word: str) -> str:
    return _DIGITS.sub("0", word.strip(_EDGE).lower())


def _words(text: str, at: int, step: int, most: int) -> list[str]:
    """Up to ``most`` whole words that end before (step -1) or start after (step 1) a place, in the order of the text."""
    out, n = [], len(text)
    lo = at - 1 if step < 0 else at
    while len(out) < most:
        while 0 <= lo < n and text[lo].isspace():
            lo += step
        hi = lo
        while 0 <= hi < n and not text[hi].isspace():
            hi += step
        if hi == lo:
            break
        out.append(text[hi + 1 : lo + 1] if step < 0 else text[lo:hi])
        lo = hi
    return out[::step]


def _shape(value: str) -> str:
    """Runs of letters as a, digits one by one as 0, other characters as they are."""
    return re.sub(r"[^\W\d_]+", "a", _DIGITS.sub("0", value))


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the word before it, two words before it, one before and one after it, and its shape behind the word before it."""
    before, after = [_normal(w) for w in _words(text, start, -1, 2)], [_normal(w) for w in _words(text, end, 1, 1)]
    out = []
    if before:
        out += [f"{before[-1]} _", f"{before[-1]} {_shape(text[start:end])}"]
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Tokens and groups of digits that look like identifiers and touch no base span; a token inside a group goes."""
    if "@" not in text and not _HAS_DIGITS.search(text):
        return []
    groups = [m.span() for m in _GROUPS.finditer(text) if len(_DIGITS.findall(m[0])) >= 7]
    out, at, taken = [], 0, merged(base)
    ends = [e for _, e in taken]
    for a, b in sorted(groups + [m.span() for m in _CANDIDATE.finditer(text)], key=lambda x: (x[0], -x[1])):
        if b <= at:
            continue
        at = b
        while a < b and text[a] in _EDGE and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        k = bisect_right(ends, a)  # the first base span that ends after the candidate starts
        if b - a >= 5 and not (k < len(taken) and taken[k][0] < b):
            out.append((a, b))
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_PLACES = "array<struct<kind:string,start:int,end:int,value:string,pattern:string>>"
_PLACES_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("pattern", pa.string())]))


def _observe(columns: list[str]):
    """Base spans of each text, and its pattern instances: seeds with their kind, candidates with none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, places = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                own = [(k, a, b) for k, a, b in base] + [(None, a, b) for a, b in candidates(text, base)]
                places.append([{"kind": k, "start": a, "end": b, "value": text[a:b], "pattern": p} for k, a, b in own for p in _context(text, a, b)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(bases, _SPANS_ARROW), pa.array(places, _PLACES_ARROW)], names=[*columns, "base", "places"])

    return run


#: Scores that differ by less are the same.
STILL = 1e-6


def _same(new: DataFrame, old: DataFrame, keys: list[str]) -> bool:
    """Whether no row of new is without one of old with its keys and its score."""
    before = old.select(*keys, F.col("score").alias("was"))
    return new.join(before, keys, "left").where(F.col("was").isNull() | (F.abs(F.col("score") - F.col("was")) >= STILL)).isEmpty()


def bootstrap(edges: DataFrame, *, support: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Score the graph of patterns and instances by turns, until a round neither adds a pattern or an instance nor moves a score.

    edges: pattern, value, kind (null for candidates), one row for each such
    triple. Seeds have score 1 for their kind. In each round a pattern's
    support for a kind is the sum of its instances' scores for it, and its
    score the share of that in all its different instances; patterns of enough
    support and score stay, and those that stayed once stay for good. An open
    instance's score for a kind is one less the product of the doubts of its
    patterns that stay; those of score ``least`` are accepted and support
    patterns like seeds in the next round, so they also induce patterns that no
    seed shows. Scores only grow, and a move by less than STILL counts as none,
    so the rounds end; each costs two joins. Returns (pattern, kind, score) and (value, kind, score) of accepted
    instances, the likeliest kind of each.
    """
    pairs = stash(edges.select("pattern", "value").distinct())
    total = stash(pairs.groupBy("pattern").agg(F.count("*").alias("total")).where(F.col("total") >= support))
    seeds = stash(edges.where("kind is not null").select("value", "kind").distinct())
    # only patterns of enough instances can ever count
    pairs = stash(pairs.join(total.select("pattern"), "pattern", "left_semi"))
    open_ = stash(pairs.join(seeds.select("value").distinct(), "value", "left_anti"))
    patterns = accepted = None
    while True:
        known = seeds.withColumn("score", F.lit(1.0))
        known = known if accepted is None else known.unionByName(accepted)
        held = pairs.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("support")).where(F.col("support") >= support)
        new = held.join(total, "pattern").select("pattern", "kind", (F.col("support") / F.col("total")).alias("score")).where(F.col("score") >= least)
        # scores only grow, so that two instances that support each other cannot come and go for ever
        new = new if patterns is None else new.unionByName(patterns).groupBy("pattern", "kind").agg(F.max("score").alias("score"))
        old_patterns, patterns = patterns, stash(new)
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("score")))))
        scored = open_.join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("score")).where(F.col("score") >= least)
        best = scored.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        if accepted is not None:
            # an instance keeps the kind that it was accepted for
            first = accepted.select("value", F.col("kind").alias("had"), F.col("score").alias("was"))
            best = best.join(first, "value", "full").select("value", F.coalesce("had", "kind").alias("kind"), F.when(F.col("had").isNull() | (F.col("had") == F.col("kind")), F.greatest("score", F.coalesce("was", "score"))).otherwise(F.col("was")).alias("score"))
        old, accepted = accepted, stash(best)
        ended = accepted.isEmpty() if old is None else _same(accepted, old, ["value"]) and _same(patterns, old_patterns, ["pattern", "kind"])
        unstash(*(x for x in (old, old_patterns) if x is not None))
        if ended:
            return patterns, accepted


def extract(docs: DataFrame, *, support: int = 5, least: float = 0.8) -> DataFrame:
    """Columns of docs other than text, plus base and spans: arrays of kind, start, end (code points, end exclusive).

    Seeds are the base spans of the whole corpus. Their contexts are patterns;
    candidates that confident patterns introduce join the base spans, wherever
    they stand, and become seeds of further patterns. Null texts count as
    empty; texts, words and identifiers of any length count whole. Rows are told
    apart by a number given when they are first stored, so repeated rows and
    null ids are fine. Columns named base, places, spans or row are replaced.
    An empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in ("text", "base", "places", "spans", "row")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in keep)
    seen = arrow_map(docs.select(*keep, F.col("text").cast("string").alias("text")), _observe(keep), f"{fields}base {_SPANS}, places {_PLACES}")
    seen = stash(seen.withColumn("row", F.monotonically_increasing_id()))
    places = seen.select("row", F.explode("places").alias("p")).select("row", "p.*")
    edges = stash(places.select("pattern", "value", "kind").distinct())
    _, accepted = bootstrap(edges, support=support, least=least)
    told = places.where("kind is null").select("row", "start", "end", "value").distinct().join(accepted.select("value", "kind"), "value")
    added = told.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return seen.join(stash(added), "row", "left").select(*keep, "base", F.concat("base", F.coalesce("added", F.array().cast(_SPANS))).alias("spans"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans(column: pa.Array) -> list[list[Span]]:
        return [ordered([(s["kind"], s["start"], s["end"]) for s in row], BASE_KINDS) for row in column.to_pylist()]

    for batch in batches:
        base, every = spans(batch.column("base")), spans(batch.column("spans"))
        n = [counts(b) for b in base]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([c[k] for c in n], pa.int64()) for k in BASE_KINDS), pa.array([digest(b) for b in base]), pa.array([joined(s) for s in every])],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
        )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of personal data in all documents. Null texts count as empty; repeated rows each stay; long texts count whole; no rows give none."""
    found = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return arrow_map(found, _digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
