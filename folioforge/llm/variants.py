"""Spelling variant grouping: automata over both halves of the words scan all words for partners at one edit."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, prepare, stash, table, unstash

#: Words whose segments one automaton holds, about; a task has one automaton and as many words to scan.
SHARD = 20_000
#: Buckets of outer letter pairs; shards are made of these, and no more rows are sent to all tasks.
BUCKETS = 1 << 13
#: Pairs that are verified at once.
PAIRS = 1 << 19
#: Code points of words that are compared in a matrix; longer ones one by one.
WIDE = 40
#: Different words that a task counts before it passes them on.
HELD = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame, least: int = 5, change: Callable[[int | None], Callable[[str], str]] | None = None) -> DataFrame:
    """word and n: counts of the runs of letters (A-Z in lower case) of ``least`` code points or more, a word on several rows.

    change(doc_id) gives what becomes of a document's runs. Null and empty texts
    have none; repeated rows count each; texts of any length are read whole; no
    rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = Counter(_RUN.findall((text or "").encode().translate(_FOLD).decode()))
                altered = change(doc_id) if change else None
                for word, n in own.items():
                    if altered:
                        word = altered(word)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield told()
        yield told()

    return arrow_map(docs.select("doc_id", "text"), run, "word string, n long")


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, 0 beyond their ends and for words over WIDE, and lengths."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    wide = min(WIDE, int(size.max(initial=1)))
    flat = np.array([w if len(w) <= wide else "" for w in words], dtype=f"<U{wide}")
    return flat.view(np.uint32).reshape(len(words), wide), size


def _verified(a: np.ndarray, b: np.ndarray, words: list[str], codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of word numbers: whether one edit leads from a to b, and whether b starts with the first half of a."""
    la, lb, wide = size[a], size[b], codes.shape[1]
    ca, cb = codes[a], codes[b]
    same = ca == cb
    edge = np.concatenate([~same, np.ones((len(a), 1), dtype=bool)], axis=1)
    prefix = np.minimum(edge.argmax(axis=1), np.minimum(la, lb))
    good = (la == lb) & ((~same).sum(axis=1) == 1)
    for short, long, cs, cl in ((la, lb, ca, cb), (lb, la, cb, ca)):
        by = np.flatnonzero(short + 1 == long)
        # what follows the common prefix agrees once the longer word lacks a letter
        shifted = np.concatenate([cl[by, 1:], np.zeros((len(by), 1), dtype=cl.dtype)], axis=1)
        rest = (cs[by] == shifted) | (np.arange(wide) < prefix[by, None])
        good[by] = rest.all(axis=1)
    for k in np.flatnonzero((la > wide) | (lb > wide)).tolist():
        one, other = words[a[k]], words[b[k]]
        good[k], prefix[k] = one_edit(one, other), len(one) // 2 if other.startswith(one[: len(one) // 2]) else 0
    return good, prefix >= la // 2


def _scan(words: list[str], patterns: list[tuple[int, int]], scanned: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (scanned word, near word) at one edit, each once over both sides.

    patterns and scanned: (number of the word, side). A word's first half, side
    0, is found where a scanned word starts, its second half, side 1, where one
    ends; a pair whose first half fits belongs to side 0.
    """
    codes, size = _matrix(words)
    segments: dict[tuple[str, int], int] = {}
    of = np.empty(len(patterns), dtype=np.int64)
    for k, (w, side) in enumerate(patterns):
        half = len(words[w]) // 2
        of[k] = segments.setdefault((words[w][half:] if side else words[w][:half], side), len(segments))
    owner = np.array([w for w, _ in patterns], dtype=np.int64)
    top = int(size.max(initial=0)) + 2
    by = np.lexsort((size[owner], of))
    owner, key = owner[by], (of * top + size[owner])[by]
    automaton = ahocorasick.Automaton()
    ids: dict[str, list[int]] = {}
    for (text, side), k in segments.items():
        ids.setdefault(text, [-1, -1])[side] = k
    for text, own in ids.items():
        automaton.add_word(text, (len(text), *own))
    automaton.make_automaton()
    hits, froms = [], []
    for w, side in scanned:
        text = words[w]
        last = len(text) - 1
        for end, (length, *own) in automaton.iter(text):
            # the segment stands at its own offset, seen from the end that the edit leaves alone
            if (k := own[side]) >= 0 and (end == last if side else end + 1 == length):
                hits.append(k)
                froms.append(w)
    hit, scan = np.array(hits, dtype=np.int64), np.array(froms, dtype=np.int64)
    lo, hi = np.searchsorted(key, hit * top + size[scan] - 1), np.searchsorted(key, hit * top + size[scan] + 1, side="right")
    side_of = np.array([side for _, side in segments], dtype=bool)
    done, total = 0, np.cumsum(hi - lo)
    while done < len(hit):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, side="right")))
        a, b = lo[done:to], hi[done:to]
        n = b - a
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        near, word, second = owner[place], np.repeat(scan[done:to], n), np.repeat(side_of[hit[done:to]], n)
        good, first = _verified(near, word, words, codes, size)
        good &= ~(second & first)
        yield word[good], near[good]
        done = to


_PART = "word string, n_near long, form_n long, form string"


def _block(rows: pa.Table) -> pa.Table:
    """Words of a block, as patterns or to be scanned: for each scanned word how many near words it has here, and the most frequent."""
    texts = rows.column("word").to_pylist()
    words = sorted(set(texts))  # numbers follow the order of code points
    number = {w: k for k, w in enumerate(words)}
    counts = np.zeros(len(words), dtype=np.int64)
    patterns, scanned = [], []
    for text, n, side, scan in zip(texts, rows.column("n").to_pylist(), rows.column("side").to_pylist(), rows.column("scanned").to_pylist()):
        counts[number[text]] = n
        (scanned if scan else patterns).append((number[text], side))
    many = np.zeros(len(words), dtype=np.int64)
    best = np.full(len(words), -1, dtype=np.int64)
    for word, near in _scan(words, patterns, scanned):
        many += np.bincount(word, minlength=len(words))
        by = np.lexsort((near, -counts[near], word))
        word, near = word[by], near[by]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, dtype=np.int64)
        w, new = word[first], near[first]
        old = best[w]
        better = (old < 0) | (counts[new] > counts[old]) | ((counts[new] == counts[old]) & (new < old))
        best[w[better]] = new[better]
    told = np.flatnonzero(many)
    return pa.table({"word": pa.array([words[k] for k in told.tolist()], pa.string()), "n_near": many[told], "form_n": counts[best[told]], "form": pa.array([words[k] for k in best[told].tolist()], pa.string())})


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """For each word (word, n; one row each) that has near words: n_near, and form and form_n, the most frequent and its count.

    Near words are one edit apart, so one half of a word stands unchanged at
    the start or end of the other, with its two outermost letters: words go to
    a shard by their first and last two letters. Small buckets of letters share
    a shard; a bucket of more words is cut into parts, and each part's automaton
    scans the bucket part by part.
    """
    outer = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, 2).alias("gram")), F.struct(F.lit(1).alias("side"), F.substring("word", -2, 2).alias("gram")))
    sides = words.where(F.length("word") >= 4).select("word", "n", F.explode(outer).alias("o")).select("word", "n", "o.side", F.pmod(F.xxhash64("o.side", "o.gram"), F.lit(BUCKETS)).alias("bucket"))
    counted = sides.groupBy("bucket").agg(F.count("*").alias("size"))
    # at most BUCKETS rows: the window and the broadcast are bounded
    place = F.sum(F.when(F.col("size") <= shard, F.col("size")).otherwise(0)).over(Window.partitionBy(F.lit(0)).orderBy("bucket"))
    shards = counted.select("bucket", F.when(F.col("size") <= shard, F.floor(place / shard)).otherwise(-1 - F.col("bucket")).alias("shard"), F.ceil(F.col("size") / shard).cast("int").alias("parts"))
    dealt = sides.join(F.broadcast(shards), "bucket")
    own, each = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    roles = F.array(F.struct(F.lit(False).alias("scanned"), F.transform(each, lambda k: F.struct(own.alias("a"), k.alias("b"))).alias("blocks")), F.struct(F.lit(True).alias("scanned"), F.transform(each, lambda k: F.struct(k.alias("a"), own.alias("b"))).alias("blocks")))
    rows = dealt.select("shard", "word", "n", "side", F.explode(roles).alias("r")).select("shard", "word", "n", "side", "r.scanned", F.explode("r.blocks").alias("x"))
    parts = rows.select("shard", "x.a", "x.b", "word", "n", "side", "scanned").groupBy("shard", "a", "b").applyInArrow(_block, _PART)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): where following forms ends. Each step doubles what has been followed; forms have no cycle."""
    now = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stash(now.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        unstash(now)
        now = new
        if not new.where("moved").head(1):
            return now.drop("moved")
        now = now.drop("moved")
        now._stash = new._stash


def variants(counts: DataFrame, *, least_n: int = 3, ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of counts (word, n) that occur ``least_n`` times or more.

    A word may stand on several rows, whose n are summed; null words do not
    count, nor other columns. n_near: words at exactly one inserted, deleted or
    replaced code point. form: of these the one with the largest n, of equal
    ones the first in the order of code points, if that n is ``ratio`` times
    the word's own or more; else form and form_n are null. root: where following
    forms ends, the word itself if it has none. Words of fewer than four code
    points have no near words. ratio is at least 2, so that forms have no cycle.
    An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2")
    prepare(counts.sparkSession)
    words = stash(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))
    near = near_words(words, shard)
    told = stash(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")]))
    unstash(words)
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def without_letter(doc_id: int | None) -> Callable[[str], str]:
    """The contract's planted misspellings: where 97 divides the CRC of id and run, the run loses a letter."""
    if doc_id is None:
        return lambda run: run
    start = zlib.crc32(f"{doc_id}:".encode())

    def altered(run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        if h % 97:
            return run
        k = h % len(run)
        return run[:k] + run[k + 1 :]

    return altered


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents with five letters and three occurrences, their near words, forms and roots. Null texts have no words and null ids plant nothing; repeated rows count each; long texts count whole; no rows give none."""
    return variants(count_words(table(spark, sf_dir, "documents"), change=without_letter))


ORACLE_SQL = r"""
WITH RECURSIVE steps AS (SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
digits AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM runs),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x) // 2 + 1),
             lambda k: CAST((instr('0123456789ABCDEF', x[2 * k - 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * k]) - 1 AS BIGINT))),
             lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM digits, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
counts AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM counts)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word AND length(a.word) = length(b.word)
          UNION SELECT a.word, b.word FROM cut a JOIN counts b ON a.less = b.word UNION SELECT b.word, a.word FROM cut a JOIN counts b ON a.less = b.word),
best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-c.n, p.near)) AS near, max(c.n) AS near_n FROM pairs p JOIN counts c ON c.word = p.near GROUP BY p.word),
told AS (SELECT counts.word, counts.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * counts.n THEN near END AS form, CASE WHEN near_n >= 2 * counts.n THEN near_n END AS form_n FROM counts LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS further FROM told UNION ALL SELECT w.word, t.word, t.form FROM walk w JOIN told t ON t.word = w.further)
SELECT told.word, told.form, w.at AS root, told.n, CAST(told.n_near AS BIGINT) AS n_near, told.form_n FROM told JOIN walk w ON w.word = told.word AND w.further IS NULL
"""
