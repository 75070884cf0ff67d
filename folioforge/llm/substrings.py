"""Exact substring dedup: word windows repeated at one length alone are extended to twice that length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, pieces, stash, table, unstash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit value for each byte value, and odd bases with their inverses: two polynomial hashes. Modulo 2 ** 64
#: some texts collide under every odd base, so these hashes find candidates only; Words.digests tells whole windows apart.
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text hashed at once, one text at least: arrays beside them take some 50 times as much.
PIECE = 250_000
#: Powers that a worker keeps between tasks, enough for a piece; a longer text has its own, which go with it.
KEPT = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i < n at least."""
    if n <= KEPT and which in _POWERS:
        return _POWERS[which]
    out = []
    for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        steps = np.full(max(n, KEPT), b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps, out=steps))
    if n <= KEPT:
        _POWERS[which] = (out[0], out[1])
    return out[0], out[1]


class Words:
    """Word bounds of all texts of a batch, in one array of bytes, and hashes of their windows."""

    def __init__(self, batch: pa.RecordBatch, column: str = "text"):
        array = batch.column(column).cast(pa.binary())
        ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if array.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        if array.null_count:  # a null may own bytes
            array = array.fill_null(b"")
            ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
            data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if array.buffers()[2] is not None else data[:0]
        ends = (ends - ends[0]).astype(np.int64)
        self.data = data
        inside = ~_SPACE[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        firsts = ends[:-1][ends[:-1] < ends[1:]]
        starts[firsts] = inside[firsts]  # words do not run on into the next text
        lasts = inside.copy()
        lasts[:-1] &= ~inside[1:]
        finals = firsts[1:] - 1
        lasts[finals] = inside[finals]
        if len(data):
            lasts[-1] = inside[-1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(lasts) + 1
        #: Words of text i are those from first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, ends)
        self.n = np.diff(self.first)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _prefix(self, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words in the text with single spaces, sums of value * base ** place before each byte, and base ** -place."""
        if which not in self._sums:
            length = self.end - self.start
            place = np.concatenate([[0], np.cumsum(length + 1)])
            shift = np.repeat(place[:-1] - self.start, length)
            inside = np.flatnonzero(~_SPACE[self.data])
            power, inverse = _powers(which, int(place[-1]) + 1)
            terms = np.zeros(int(place[-1]) + 1, dtype=np.uint64)
            terms[place[1:] - 1] = _VALUES[which][32] * power[place[1:] - 1]
            at = inside + shift
            terms[at] = _VALUES[which][self.data[inside]] * power[at]
            sums = np.zeros(len(terms) + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            self._sums[which] = (place, sums, inverse)
        return self._sums[which]

    def hashes(self, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        """Hashes of the ``width`` words from each word in ``at``; all must lie in their texts."""
        place, sums, inverse = self._prefix(which)
        lo, hi = place[at], place[at + width] - 1
        x = (sums[hi] - sums[lo]) * inverse[lo]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x

    def digests(self, at: np.ndarray, width: int) -> np.ndarray:
        """128 bits of the bytes of the ``width`` words from each word in ``at``, joined by single spaces: two columns."""
        length = self.end - self.start
        place = np.concatenate([[0], np.cumsum(length + 1)])
        joined = np.full(int(place[-1]), 32, dtype=np.uint8)
        inside = np.flatnonzero(~_SPACE[self.data])
        joined[inside + np.repeat(place[:-1] - self.start, length)] = self.data[inside]
        view = memoryview(joined.tobytes())
        digest = xxhash.xxh3_128_digest
        out = b"".join([digest(view[a:b]) for a, b in zip(place[at].tolist(), (place[at + width] - 1).tolist())])
        return np.frombuffer(out, dtype="<i8").reshape(-1, 2)

    def windows(self, width: int) -> np.ndarray:
        """The words that start a window of ``width`` words of one text."""
        fits = np.maximum(self.n - width + 1, 0)
        base = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(fits)[:-1]]), fits)
        return base + np.arange(int(fits.sum()))


#: Words of a piece of work whose places fit beside their hashes in 64 bits; texts of more words take more steps.
PLACES = 1 << 24


def _chosen_long(h: np.ndarray, parts: np.ndarray, starts: np.ndarray, span: int, n: int) -> np.ndarray:
    """As in _chosen, for any number of words: places of the least hashes are kept apart from the hashes."""
    key = np.full(n + span, ~np.uint64(0), dtype=np.uint64)
    key[parts] = h >> np.uint64(24)  # the bits that _chosen compares
    at = np.arange(n + span, dtype=np.int64)
    step = 1
    while step * 2 <= span:
        other = np.concatenate([at[step:], at[-step:]])
        at = np.where(key[other] < key[at], other, at)
        step *= 2
    one, other = at[starts], at[starts + span - step]
    return np.where(key[other] < key[one], other, one)


def _chosen(words: Words, starts: np.ndarray, target: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``target`` words at ``starts`` (all windows of the batch): the word at which the least part of ``width`` words starts.

    The choice depends on the window's words alone, so equal windows choose
    equal parts and a repeated window is one whose part is repeated.
    Returns that word for each window, and the hash of each word's part.
    """
    parts = words.windows(width)
    h = words.hashes(parts, width)
    full = np.zeros(len(words.start), dtype=np.uint64)
    full[parts] = h
    if len(words.start) >= PLACES:
        return _chosen_long(h, parts, starts, target - width + 1, len(words.start)), full
    low = np.uint64(PLACES - 1)
    span = target - width + 1
    key = np.full(len(words.start) + span, ~np.uint64(0), dtype=np.uint64)
    key[parts] = (h & ~low) | parts.astype(np.uint64)  # ties go to the leftmost
    step, least = 1, key
    while step * 2 <= span:
        least = np.minimum(least, np.concatenate([least[step:], np.full(step, ~np.uint64(0))]))
        step *= 2
    if step < span:
        least = np.minimum(least[starts], least[starts + span - step])
    else:
        least = least[starts]
    return (least & low).astype(np.int64), full


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each text of the batch: copies add nothing but work."""
    both = np.stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()], axis=1)
    _, at = np.unique(both, axis=0, return_index=True)
    return batch if len(at) == len(batch) else batch.take(pa.array(np.sort(at)))


def _first_level(target: int, width: int):
    """Texts in; hash, key and place of the chosen parts out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(_once(whole), "text", PIECE):
                words = Words(batch)
                starts = words.windows(target)
                picked, full = _chosen(words, starts, target, width)
                picked = np.unique(picked)
                text = np.searchsorted(words.first, picked, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[picked].view(np.int64)), batch.column("k1").take(pa.array(text)), pa.array((picked - words.first[text]).astype(np.int32))], names=["h", "k1", "pos"]
                )

    return run


def _alive(words: Words, places: list, target: int, width: int) -> np.ndarray:
    """Windows of ``target`` words whose chosen part of ``width`` words starts at one of the places."""
    starts = words.windows(target)
    if width == target:
        chosen = starts
    else:
        chosen, _ = _chosen(words, starts, target, width)
    marked = np.zeros(len(words.start) + 1, dtype=bool)
    for i, own in enumerate(places):
        if own is not None:
            at = np.asarray(own, dtype=np.int64)
            marked[words.first[i] + at[at < words.n[i]]] = True
    return starts[marked[chosen]]


def _copies(batch: pa.RecordBatch) -> pa.Array:
    """How many rows have each row's text: of the copied texts that share the first half of its key, the one with its second half."""
    out = [1 if own is None else next((c["copies"] for c in own if c["k2"] == k), 1) for own, k in zip(batch.column("copied").to_pylist(), batch.column("k2").to_pylist())]
    return pa.array(out, pa.int64())


def _next_level(target: int, width: int, wider: int):
    """Texts and places of the parts that are repeated; hash, key and place of wider parts out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(_once(whole), "text", PIECE):
                words = Words(batch)
                alive = _alive(words, batch.column("places").to_pylist(), target, width)
                if wider == target:
                    picked = alive
                else:
                    chosen, _ = _chosen(words, words.windows(target), target, wider)
                    of = np.zeros(len(words.start) + 1, dtype=np.int64)
                    of[words.windows(target)] = chosen
                    picked = np.unique(of[alive])
                text = np.searchsorted(words.first, picked, side="right") - 1
                take = pa.array(text)
                if wider == target:
                    h, g = words.digests(picked, wider).T
                else:
                    h, g = (words.hashes(picked, wider, which).view(np.int64) for which in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(h)),
                        pa.array(np.ascontiguousarray(g)),
                        batch.column("k1").take(take),
                        batch.column("k2").take(take),
                        pa.array((picked - words.first[text]).astype(np.int32)),
                        _copies(batch).take(take),
                    ],
                    names=["h", "g", "k1", "k2", "pos", "copies"],
                )

    return run


def _removal(target: int, with_text: bool):
    """Texts, windows that are repeated and copies of the text in; counts and what is kept out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                words = Words(batch)
                gone = np.zeros(len(words.start) + 1, dtype=np.int64)
                for i, (own, copies) in enumerate(zip(batch.column("places").to_pylist(), batch.column("copies").to_pylist())):
                    lo, n = words.first[i], words.n[i]
                    if copies is not None and copies > 1 and n >= target:
                        own = range(n - target + 1)
                    if own is not None and len(own):
                        at = lo + np.asarray(own, dtype=np.int64)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + target, -1)
                gone = np.cumsum(gone)[:-1] > 0
                data, kept, removed = words.data.tobytes(), [], []
                for i in range(len(words.n)):
                    lo, hi = words.first[i], words.first[i + 1]
                    own = np.flatnonzero(~gone[lo:hi]) + lo
                    removed.append(int(hi - lo - len(own)))
                    kept.append(b" ".join([data[a:b] for a, b in zip(words.start[own].tolist(), words.end[own].tolist())]))
                out = [pa.array(words.n.astype(np.int64)), pa.array(removed, pa.int64())]
                if with_text:
                    # a text that loses nothing stays as it is, its spaces too
                    texts = batch.column("text").cast(pa.binary()).to_pylist()
                    out.append(pa.array([k if r else t for k, r, t in zip(kept, removed, texts)], pa.binary()).cast(pa.string()))
                    names = [n for n in batch.schema.names if n not in ("k1", "k2", "places", "copies", "text")]
                else:
                    out.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                    names = ["doc_id"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out], names=[*names, "n_words", "n_removed", "text" if with_text else "kept_sha256"])

    return run


KEY = ["k1", "k2"]


def repeated_windows(docs: DataFrame, *, target: int = 35, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Keyed texts (docs with k1 and k2, 128 bits of a hash of the text), and by key the places of repeated windows and the copies of the text.

    Level by level: a window's least part of ``start`` words is counted over
    the corpus, windows whose part stands alone are dropped, the others are
    tested with parts twice as long, up to the whole window: 9, 18 and 35 words
    by default. Each repeated window passes every level, as its copies choose
    the same parts. The last level compares the XXH3-128 of the whole window's bytes.
    Before it, places go by k1 alone: texts that share it only add candidates.
    """
    widths = [start or -(-target // 4)]
    while widths[-1] < target:
        widths.append(min(target, widths[-1] * 2))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(1), text))
    texts = keyed.select(*KEY, text.alias("text"))
    copies = stash(texts.groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1"))
    copied = stash(copies.groupBy("k1").agg(F.collect_list(F.struct("k2", "copies")).alias("copied")))
    found = stash(arrow_map(texts, _first_level(target, widths[0]), "h long, k1 long, pos int"))
    often = stash(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    places = found.join(often, "h", "left_semi")
    levels = list(zip(widths, widths[1:]))
    if not levels:
        # the first level is the last one: its hashes are 64 bits, so the whole windows are hashed again
        levels = [(target, target)]
    for width, wider in levels:
        last = wider == target
        told = stash(places.groupBy("k1").agg(F.collect_set("pos").alias("places")).join(copied, "k1", "left"))
        unstash(found, often)
        found = stash(arrow_map(texts.join(told, "k1"), _next_level(target, width, wider), "h long, g long, k1 long, k2 long, pos int, copies long"))
        unstash(told)
        mark = F.xxhash64(*KEY, "pos")
        often = found.groupBy("h", "g").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.max("copies").alias("c"))
        often = stash(often.where("lo <> hi or c > 1").select("h", "g"))
        # a text with copies loses all its windows anyway, but others may repeat them until the last level
        places = (found.where("copies = 1") if last else found).join(often, ["h", "g"], "left_semi")
    told = stash(places.groupBy(*KEY).agg(F.collect_set("pos").alias("places")).join(copies, KEY, "full").select(*KEY, "places", "copies"))
    unstash(found, often)
    return keyed, told


def substring_dedup(docs: DataFrame, *, target: int = 35, start: int | None = None) -> DataFrame:
    """Remove every word that a repeated window of ``target`` words covers, in all its places.

    Returns docs with text replaced by the kept words joined by one space where
    words went, unchanged elsewhere, plus n_words and n_removed. A window is
    repeated if its word sequence starts anywhere else in the corpus, same
    document included, so all copies of a text of ``target`` words or more
    become empty, repeated rows too. Null texts count as empty and come back
    empty. Texts of any length are read whole. Ids play no part; null ids and
    other columns pass through, and so does an empty table.
    """
    others = [f"`{c}`" for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    # other columns travel as one, so that their names clash with none here
    carried = F.struct(*others) if others else F.lit(None).cast("string")
    given = docs.select(carried.alias("carried"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed, told = repeated_windows(given, target=target, start=start)
    kind = given.schema["carried"].dataType.simpleString()
    done = arrow_map(keyed.join(told, KEY, "left"), _removal(target, True), f"carried {kind}, n_words long, n_removed long, text string")
    return done.select(*(["carried.*"] if others else []), "text", "n_words", "n_removed")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words removed and a digest of those kept, for all documents. Null texts have none; repeated rows of 35 words or more lose all; long texts count whole; no rows give none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed, told = repeated_windows(docs)
    keyed = keyed.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return arrow_map(keyed.join(told, KEY, "left"), _removal(35, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM win WHERE g IN (SELECT g FROM rep)),
gone AS (SELECT doc_id, list(j) AS js FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN ws ELSE
         list_transform(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(js, j)), lambda j: ws[j]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
