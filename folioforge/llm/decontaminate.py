"""Benchmark decontamination: an FM-index for each shard of texts, in which the windows of all test items are searched."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, stash, table, unstash
from folioforge.llm.fmindex import FMIndex

WIDTH = 10
#: Words of one shard, and bytes of text after which the rows so far are indexed.
SHARD_WORDS, SHARD_BYTES = 1 << 20, 6 << 20
#: Words of test items in one block, about; a window starts at each, so what is sent to all tasks is some 25 MB at most.
#: More items take more passes.
BLOCK_WORDS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


class Words:
    """Folded words of texts, and where in the texts' bytes they stand."""

    def __init__(self, texts: pa.Array):
        array = texts.cast(pa.binary()).fill_null(b"")
        ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        inside = _INSIDE[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, stops = edge == 1, edge == -1
        seams = ends[1:-1]
        seams = seams[(seams > 0) & (seams < len(data))]
        seams = seams[inside[seams - 1] & inside[seams]]  # words do not run on into the next text
        starts[seams] = stops[seams] = True
        self.data, self.ends = data, ends
        self.start, self.stop = np.flatnonzero(starts), np.flatnonzero(stops)
        #: Words of text i are those from first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, ends)
        bounds = np.concatenate([[0], np.cumsum(self.stop - self.start)]).astype(np.int32)
        flat = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(_FOLD[data[inside]])])
        coded = flat.dictionary_encode()
        #: A number from 0 for each word, and the words by number.
        self.number, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def code_points(self, text: int, words: np.ndarray, stop: bool) -> np.ndarray:
        """Where words of one text start (or stop), in code points of the text."""
        lo, hi = self.ends[text], self.ends[text + 1]
        heads = np.concatenate([[0], np.cumsum((self.data[lo:hi] & 0xC0) != 0x80)])
        return heads[(self.stop if stop else self.start)[words] - lo]


def shards(first: np.ndarray, most: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of words (first and last + 1) of at most ``most`` words in all; a longer text is cut, with so many words in common."""
    lo: list[int] = []
    hi: list[int] = []
    held = 0
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        while a < b:
            to = min(b, a + most)
            if held and held + to - a > most:
                yield np.array(lo), np.array(hi)
                lo, hi, held = [], [], 0
            lo.append(a)
            hi.append(to)
            held += to - a
            a = b if to == b else to - overlap
    if lo:
        yield np.array(lo), np.array(hi)


@dataclass
class Block:
    """Different windows of test items, as word numbers flush right, and the items that hold each."""

    names: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    item_first: np.ndarray
    item_of: np.ndarray
    items: list[str | None]


def _block(rows: list, width: int) -> Block:
    """rows: item_id and words of pieces of items."""
    coded = pa.array([w for r in rows for w in r.words], pa.string()).cast(pa.binary()).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) + 1
    items = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x))
    place = {x: k for k, x in enumerate(items)}
    size = np.array([len(r.words) for r in rows], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    many = np.maximum(size - width + 1, 1)
    piece = np.repeat(np.arange(len(rows)), many)
    start = begin[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(size, width)[piece]
    at = start[:, None] + np.arange(width) - (width - length)[:, None]
    padded = np.where(np.arange(width) >= (width - length)[:, None], np.concatenate([number, [0]])[np.clip(at, 0, len(number))], 0)
    # 0 in front alone tells lengths apart
    windows, which = np.unique(padded, axis=0, return_inverse=True) if len(padded) else (padded, np.zeros(0, dtype=np.int64))
    owner = np.array([place[r.item_id] for r in rows], dtype=np.int64)[piece] if len(rows) else np.zeros(0, dtype=np.int64)
    pairs = np.unique(which.reshape(-1) * max(1, len(items)) + owner)
    of, item = np.divmod(pairs, max(1, len(items)))
    return Block(coded.dictionary, windows.astype(np.int32), (windows > 0).sum(axis=1), np.searchsorted(of, np.arange(len(windows) + 1)), item, items)


def blocks(benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The windows of all items, in blocks of bounded size. Long items are cut so that each window stands in one piece."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1).alias("words")).where("size(words) > 0")
    step = 4096
    cut = F.explode(F.expr(f"sequence(0, greatest(size(words) - {width}, 0), {step})"))
    pieces = words.withColumn("at", cut).select("item_id", F.expr(f"slice(words, at + 1, {step} + {width} - 1)").alias("words"))
    # whole items, or pieces, go to a block by what they hold: each has about its share
    pieces = stash(pieces.withColumn("deal", F.xxhash64("item_id", "words")))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        yield _block(pieces.where(F.expr(f"pmod(deal, {n}) = {k}")).select("item_id", "words").collect(), width)
    if not n:
        yield _block([], width)
    unstash(pieces)


def occurrences(words: Words, block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the window, and first word, of each place where a window of the block stands: by an index for each shard."""
    found, where = [], []
    if len(block.windows):
        for lo, hi in shards(words.first, SHARD_WORDS, width - 1):
            size = hi - lo
            begin = np.cumsum(size + 1) - (size + 1)
            of = np.repeat(lo - begin, size + 1) + np.arange(int((size + 1).sum()))  # the word at each symbol but the ends
            ends = begin + size
            of[ends] = 0
            symbols, names = words.number[of], words.names
            if int(size.sum()) < len(words.start):
                numbers, symbols = np.unique(symbols, return_inverse=True)  # numbered without gaps
                symbols, names = symbols.reshape(-1), names.take(pa.array(numbers))
            symbols = symbols + 1
            symbols[ends] = 0
            index = FMIndex(symbols)
            known = pc.index_in(block.names, names).fill_null(-1).to_numpy()
            own = np.concatenate([[0], known + 1])[block.windows]
            # a word that the shard lacks has number 0, as has what stands in front of a short window
            a, b = index.search(own, block.lengths)
            hit = np.flatnonzero(a < b)
            n = (b - a)[hit]
            rows = np.repeat(a[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(np.repeat(hit, n))
            where.append(of[index.locate(rows)])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found), np.concatenate(where)) if found else (none, none)


_ADDED = ("n_words", "n_hit", "items", "spans")


def _hits(words: Words, block: Block, width: int, hits: list, items: list) -> None:
    """Add to each text's hit words, as (first, last + 1) within it, and to its items."""
    window, at = occurrences(words, block, width)
    text = np.searchsorted(words.first, at, side="right") - 1
    mark = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + block.lengths[window], -1)
    covered = np.cumsum(mark) > 0
    for i in np.unique(text).tolist():
        lo, hi = words.first[i], words.first[i + 1]
        own = covered[lo:hi].copy()
        for a, b in hits[i]:
            own[a:b] = True
        hits[i] = list(map(tuple, np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()))
    many = np.diff(block.item_first)[window]
    item = block.item_of[np.repeat(block.item_first[:-1][window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    pairs = np.unique(np.repeat(text, many) * max(1, len(block.items)) + item)
    for i, k in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(block.items))))):
        if block.items[k] is not None:
            items[i] = sorted({*items[i], block.items[k]})


def _search(sent, width: int, keep: list[str], last: bool):
    """Rows in, with what earlier blocks have found in state; the rows with what this one adds out, counts and places with the last."""

    def told(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        coded = rows.column("searched").combine_chunks().dictionary_encode()  # copies are indexed once
        texts, first = coded.dictionary, np.zeros(len(coded.dictionary), dtype=np.int64)
        which = coded.indices.to_numpy()
        first[which[::-1]] = np.arange(len(which))[::-1]
        before = rows.column("state").take(pa.array(first)).to_pylist()
        hits = [[(h["a"], h["b"]) for h in x["hits"]] if x else [] for x in before]
        items = [x["items"] if x else [] for x in before]
        words = Words(texts)
        _hits(words, sent.value, width, hits, items)
        take = pa.array(which)
        if last:
            spans = [[{"start": a, "end": b} for a, b in zip(words.code_points(i, words.first[i] + np.array([a for a, _ in h]), False).tolist(), words.code_points(i, words.first[i] + np.array([b for _, b in h]) - 1, True).tolist())] if h else [] for i, h in enumerate(hits)]
            out = {
                "n_words": pa.array(np.diff(words.first).astype(np.int64)), "n_hit": pa.array([sum(b - a for a, b in h) for h in hits], pa.int64()),
                "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
        else:
            state = [{"hits": [{"a": a, "b": b} for a, b in h], "items": x} for h, x in zip(hits, items)]
            out = {"state": pa.array(state, pa.struct([("hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))]))}
        kept = [*keep, *([] if last else ["searched"])]
        for batch in pa.table([*(rows.column(c) for c in kept), *(x.take(take) for x in out.values())], names=[*kept, *out]).to_batches():
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("searched").nbytes
            if size >= SHARD_BYTES:
                yield from told(held)
                held, size = [], 0
        if held:
            yield from told(held)

    return run


_STATE = "struct<hits:array<struct<a:bigint,b:bigint>>,items:array<string>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_words: int = BLOCK_WORDS, columns: list[str] | None = None) -> DataFrame:
    """Columns of docs (or those named), plus n_words, n_hit, items and spans, which replace columns of these names.

    docs: text and any others. benchmark: item_id, text. A window is ``width``
    consecutive words of an item, or all words of one with fewer; a word of a
    document is hit inside any place where a window stands. items: the ids, as
    text and in order, of items with such a window; spans: the hit stretches in
    code points, end exclusive, for removal. Null and empty texts have no words
    and hit nothing; an item whose id is null hits words but is not named;
    repeated items count once; repeated rows are each judged. Texts of any length
    are searched whole. Empty tables give no rows or no hits.

    Each task indexes the texts of its partition shard by shard, in bounded
    memory, and searches all windows in each index: no shuffle. Windows are sent
    to the tasks in blocks of at most ``block_words`` words; further blocks
    take further passes over the documents.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in _ADDED])
    keep = [c for c in docs.columns if columns is None or c in columns]
    kept = F.struct(*[f"`{c}`" for c in keep]) if keep else F.lit(None).cast("string")
    # other columns travel as one, so that their names clash with none here
    rows = docs.select(kept.alias("carried"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("searched"), F.lit(None).cast(_STATE).alias("state"))
    carried = f"carried {rows.schema['carried'].dataType.simpleString()}"
    spark, old = docs.sparkSession, None
    queue = blocks(benchmark, width, block_words)
    block = next(queue)
    while block is not None:
        after = next(queue, None)
        sent = spark.sparkContext.broadcast(block)
        if after is None:
            done = arrow_map(rows, _search(sent, width, ["carried"], True), f"{carried}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
            return done.select(*(["carried.*"] if keep else []), *_ADDED)
        rows = stash(arrow_map(rows, _search(sent, width, ["carried"], False), f"{carried}, searched string, state {_STATE}"))
        sent.unpersist()
        if old is not None:
            unstash(old)
        old, block = rows, after
    raise AssertionError("blocks() gives one block at least")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items found of all documents. Null texts have no words; repeated rows each stay; long texts count whole; no rows give none."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
win AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
        FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)),
occ AS (SELECT r, i, win.k AS k, item FROM win JOIN w ON win.k = w.k AND win.g = w.g),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM occ) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM occ GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
