"""Periodic run detection: Lyndon arrays over both orders of the words, with the extensions matched before used again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, pieces, table
from folioforge.llm.substrings import _SPACE, Words

#: Words of a run at least, and how often its period fits in at least.
LEAST, TIMES = 24, 3

Run = tuple[int, int, int]

#: Shorter matches are cheaper to compare again than to keep.
_SHORT = 4


def lyndon(ranks: list[int], edge, cost: list[int] | None = None) -> list[int]:
    """Where the next smaller suffix of each place starts; the Lyndon array is that less the place.

    ranks: a rank above 0 for each letter. For each place j whose next smaller
    suffix starts at i with the same letter, edge(j, i, matched) is told how far
    the two agree. The suffixes seen stand on a stack, each greater than those
    below. Letters are compared from where an earlier match tells nothing more:

    - what stands below a suffix that has just gone agrees with it as far as was
      found when that one came, so the two lengths decide unless they are equal;
    - inside the stretch that repeats what stood ``shift`` places before, a pair
      agrees as its image did, up to the stretch's end.

    So letters match anew only beyond the furthest place seen, and the number
    of comparisons is linear; ``cost`` gets it, if given.
    """
    n = len(ranks)
    w = [*ranks, 0, -1]  # an end below all letters, and what the stack stands on
    after, stack, known, wide, compared = [n] * n, [n + 1], {}, n + 2, 0
    begin = end = shift = 0
    for i in range(n + 1):
        c = w[i]
        j = stack[-1]
        x = w[j]
        gone, matched = -1, 0
        while x >= c:
            if x > c:
                after[j] = i
                stack.pop()
                gone = -1
            else:
                # how far suffixes j and i agree
                size, exact = 1, False
                if gone >= 0 and (m := known.get(j * wide + gone)) is not None:
                    size, exact = min(m, matched), m != matched
                if not exact and i + size < end and j >= begin and (m := known.get((j - shift) * wide + i - shift)) is not None:
                    size, exact = (m, True) if m < end - i else (end - i, False)
                if not exact:
                    a, b = j + size, i + size
                    while w[a] == w[b]:
                        a += 1
                        b += 1
                    compared += b - i - size + 1
                    size = b - i
                if size >= _SHORT:
                    known[j * wide + i] = size
                    if i + size >= end:
                        begin, end, shift = i, i + size, i - j
                if w[j + size] < w[i + size]:
                    break
                after[j] = i
                edge(j, i, size)
                stack.pop()
                gone, matched = (j, size) if size >= _SHORT else (-1, 0)
            j = stack[-1]
            x = w[j]
        stack.append(i)
    if cost is not None:
        cost.append(compared)
    return after


def find_runs(ranks: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of the runs with ``times`` periods and ``least`` letters or more, by start and then period; times is at least 2.

    A run has a Lyndon word of its period's length in one of the two orders of
    the letters, from whose place to the next smaller suffix is one period.
    """
    n = len(ranks)
    if n < max(least, 2):
        return []
    found: dict[tuple[int, int], Run] = {}

    def edge(j: int, i: int, matched: int) -> None:
        p = i - j
        if matched + 2 * p <= least or matched + 2 * p <= times * p or (end := i + matched, p) in found:
            return
        a = j
        while a > 0 and ranks[a - 1] == ranks[a - 1 + p]:
            a -= 1
        if end - a >= least and end - a >= times * p:
            found[end, p] = (a, end - a, p)

    lyndon(ranks, edge)
    top = max(ranks) + 1
    lyndon([top - r for r in ranks], edge)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    mark = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return np.cumsum(mark)[:-1] > 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period; of equal ones that of the least start, then period."""
    best: Run | None = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _numbered(words: Words) -> np.ndarray:
    """The rank of each word of a batch among its different words, from 1, in the order of their bytes."""
    bounds = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(words.data[~_SPACE[words.data]]))])
    coded = flat.dictionary_encode()
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank) + 1)
    return rank[coded.indices.to_numpy()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "searched"):
                words = Words(batch, "searched")
                ranks, data = _numbered(words).tolist(), words.data.tobytes()
                found, texts, counts = [], [], []
                for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    runs = find_runs(ranks[lo:hi], least, times)
                    own = np.flatnonzero(~dropped(hi - lo, runs)) + lo if runs else range(lo, hi)
                    found.append([{"start": a, "length": b, "period": p} for a, b, p in runs])
                    start, end = (words.start[own], words.end[own]) if runs else (words.start[lo:hi], words.end[lo:hi])
                    texts.append(b" ".join([data[a:b] for a, b in zip(start.tolist(), end.tolist())]))
                    best = strongest(runs)
                    counts.append(best and {"start": best[0], "length": best[1], "period": best[2]})
                out = [pa.array(words.n.astype(np.int64)), pa.array(found, pa.list_(_RUN)), pa.array(counts, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("carried"), *out], names=["carried", *_ADDED])

    return run


_ADDED = ("n_words", "runs", "strongest", "collapsed")
_KIND = "struct<start:bigint,length:bigint,period:bigint>"


def collapse_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES, columns: list[str] | None = None) -> DataFrame:
    """Columns of docs (or those named), plus n_words, runs, strongest and collapsed, which replace columns of these names.

    Words are what stands between spaces, tabs and line breaks. A run is a
    stretch with a least period that no neighbouring word extends, ``least``
    words and ``times`` periods long at least (times: 2 or more). runs: start
    (a word's number), length and period of all, by start and then period;
    strongest: the one with most periods, else null; collapsed: the words that no
    run holds after its first period, joined by one space. Null, empty and blank
    texts have no words and collapse to an empty text. Each row is judged alone:
    repeated rows, null ids and other columns pass through. Texts of any length
    are read whole, in time and memory linear in it. No rows give none.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in _ADDED])
    keep = [c for c in docs.columns if columns is None or c in columns]
    kept = F.struct(*[f"`{c}`" for c in keep]) if keep else F.lit(None).cast("string")
    # other columns travel as one, so that their names clash with none here
    rows = docs.select(kept.alias("carried"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("searched"))
    kind = rows.schema["carried"].dataType.simpleString()
    done = arrow_map(rows, _collapse(least, times), f"carried {kind}, n_words long, runs array<{_KIND}>, strongest {_KIND}, collapsed string")
    return done.select(*(["carried.*"] if keep else []), *_ADDED)


def planted(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that the query's contract plants by the document's number."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        new = {k: b" ".join(planted(i, (texts[k].as_py() or "").encode().split())).decode() for k, i in enumerate(ids) if i is not None and zlib.crc32(str(i).encode()) % 10 == 0}
        if new:
            mask = np.zeros(len(ids), dtype=bool)
            mask[list(new)] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(new.values()), pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents after planting, the strongest, and a digest of what is left. Null texts have no words, null ids plant nothing; repeated rows each stay; long texts count whole; no rows give none."""
    docs = arrow_map(table(spark, sf_dir, "documents").select("doc_id", "text"), _planted, "doc_id long, text string")
    found = collapse_runs(docs, columns=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
