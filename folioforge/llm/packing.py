"""Sequence packing by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import base64
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, stash, table, unstash

CAPACITY = 1024
#: Ends each document.
SEPARATOR = 2
#: Items of a shard, which is packed on its own; islands that each search for a packing of it, and epochs between
#: which each island's elite also moves to the next island; generations of an epoch, and packings on an island.
SHARD, ISLANDS, EPOCHS, GENERATIONS, HERD = 4096, 3, 3, 15, 6
#: The items of a shard's sequences below this fill are packed once more with those of other shards, the least filled
#: ones first and at most this share of them, so that each level is a fraction of the one before.
FULL, LOOSE = 0.995, 0.25


@lru_cache(maxsize=2)
def _encoder(ranks: str):
    """The vocabulary of byte_bpe_50k.json as ranks: the tokenizers library is four times slower for the same ids."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": 50256})


def token_ids(text: str, ranks: str) -> np.ndarray:
    encoder = _encoder(ranks)
    ids = encoder.encode(text, allowed_special="all") if "<|endoftext|>" in text else encoder.encode_ordinary(text)
    return np.append(np.asarray(ids, dtype=np.uint32), np.uint32(SEPARATOR))


def _cut(ranks: str, capacity: int):
    """Documents in, pieces out. The first piece takes the remainder, the others are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = token_ids(text or "", ranks)
                n = len(ids)
                data, first = ids.astype("<u4").tobytes(), n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


Packing = list[list[int]]
#: A bin with its fill; bins never change, so packings share those that they have in common. Packings inside stand with the least filled bin first.
Bin = tuple[int, tuple[int, ...]]


def _placed(sizes: list[int], items: list[int], capacity: int, bins: list[Bin]) -> list[Bin]:
    """Bins with the items, the largest put first, each where the least room stays; those that fit nowhere open new bins."""
    rooms = sorted([(capacity - fill, k) for k, (fill, _) in enumerate(bins) if fill < capacity])
    added: dict[int, list[int]] = {}
    n = len(bins)
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k, n = capacity, n, n + 1
        added.setdefault(k, []).append(i)
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], k))
    out = list(bins)
    for k, own in added.items():
        fill = sum([sizes[i] for i in own])
        if k < len(bins):
            out[k] = (bins[k][0] + fill, bins[k][1] + tuple(own))
        else:
            out.append((fill, tuple(own)))
    out.sort()
    return out


def best_fit(sizes: list[int], items: list[int], capacity: int) -> Packing:
    """Put items, the largest first, where the least room stays."""
    return [list(b) for _, b in _placed(sizes, items, capacity, [])]


def _score(bins: list[Bin]) -> tuple[int, int]:
    """Fewer bins are better; of equally many, fuller and emptier ones: Falkenauer's squared fills, negated."""
    return len(bins), -sum([fill * fill for fill, _ in bins])


def _exchange(sizes: list[int], bins: list[Bin], loose: list[int], capacity: int) -> tuple[list[Bin], list[int]]:
    """Replace items of bins by larger loose ones that still fit, the best replacement of a bin first; the bins and what is loose then."""
    loose = sorted(loose, key=lambda i: sizes[i])
    keys, out = [sizes[i] for i in loose], []
    for one in bins:
        room = capacity - one[0]
        if room and keys and keys[-1] > 1:
            own = list(one[1])
            while room:
                gain, place, at = 0, 0, 0
                for p, i in enumerate(own):
                    k = bisect_right(keys, sizes[i] + room) - 1
                    if k >= 0 and keys[k] - sizes[i] > gain:
                        gain, place, at = keys[k] - sizes[i], p, k
                if not gain:
                    break
                gone, own[place] = own[place], loose.pop(at)
                keys.pop(at)
                k = bisect_right(keys, sizes[gone])
                keys.insert(k, sizes[gone])
                loose.insert(k, gone)
                room -= gain
            one = (capacity - room, tuple(own))
        out.append(one)
    return out, loose


def _refit(sizes: list[int], bins: list[Bin], displaced: list[int], capacity: int) -> list[Bin]:
    bins, displaced = _exchange(sizes, sorted(bins), displaced, capacity)
    return _placed(sizes, displaced, capacity, bins)


def _cross(sizes: list[int], one: list[Bin], other: list[Bin], capacity: int, draw: random.Random) -> list[Bin]:
    """Inject whole well-filled bins of one parent, drop the other's bins that hold the same items, best-fit what they displace."""
    injected = [b for b in one[-max(1, len(one) // 2) :] if draw.random() < 0.5] or [one[-1]]
    taken = {i for _, b in injected for i in b}
    kept, displaced = [], []
    for b in other:
        if taken.isdisjoint(b[1]):
            kept.append(b)
        else:
            displaced += [i for i in b[1] if i not in taken]
    return _refit(sizes, injected + kept, displaced, capacity)


def _mutate(sizes: list[int], bins: list[Bin], capacity: int, draw: random.Random, share: float) -> list[Bin]:
    """Empty a share of the bins, half of them the least filled, and place their items anew."""
    n = max(2, int(len(bins) * share))
    out = {*range(min(len(bins), n - n // 2)), *(draw.randrange(len(bins)) for _ in range(n // 2))}
    return _refit(sizes, [b for k, b in enumerate(bins) if k not in out], [i for k in out for i in bins[k][1]], capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """So many bins are as few as can be."""
    return -(-sum(sizes) // capacity)


def evolve(sizes: list[int], capacity: int = CAPACITY, *, elites: list[Packing] | None = None, generations: int = GENERATIONS, herd: int = HERD, seed: int = 0) -> Packing:
    """The best packing of all sizes that some generations find, starting from elites, or from best fit without any. Only a packing that cannot be bettered ends the search sooner."""
    if not sizes:
        return []
    draw, enough = random.Random(seed), least_bins(sizes, capacity)
    first = [sorted((sum([sizes[i] for i in b]), tuple(b)) for b in e) for e in elites or [best_fit(sizes, list(range(len(sizes))), capacity)]]
    scored = lambda bins: (_score(bins), bins)
    all_ = [scored(bins) for bins in first]
    by_score = lambda x: x[0]
    if min(map(by_score, all_))[0] > enough:
        while len(all_) < herd:
            all_.append(scored(_mutate(sizes, first[len(all_) % len(first)], capacity, draw, 0.3)))
        for _ in range(generations):
            all_.sort(key=by_score)
            if all_[0][0][0] <= enough:
                break
            (_, one), (_, other) = draw.sample(all_[: herd // 2 + 1], 2)
            all_[-1] = scored(_mutate(sizes, _cross(sizes, one, other, capacity, draw), capacity, draw, 0.05))
    out = [list(b) for _, b in min(all_, key=by_score)[1]]
    assert sorted(i for b in out for i in b) == list(range(len(sizes)))
    return out


_TOLD = "shard long, island int, item long, length long, bin int, offset long, loose boolean, bins int, score double, done boolean"


def _epoch(capacity: int, loose: float, search: dict, epoch: int):
    """One island's packings of a shard in, its own and a guest from the island before; its best after an epoch out."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["guest", "item"], ignore_index=True)
        shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
        own = frame[~frame["guest"]].reset_index(drop=True)
        sizes = own["length"].tolist()
        elites: list[Packing] = []
        if epoch:
            for _, part in frame.groupby("guest"):
                bins: dict[int, list[int]] = {}
                for i, k in enumerate(part["bin"].tolist()):
                    bins.setdefault(k, []).append(i)
                elites.append(list(bins.values()))
        found = evolve(sizes, capacity, elites=elites, seed=(shard * ISLANDS + island) * EPOCHS + epoch, **search)
        filled = sorted((sum([sizes[i] for i in b]), tuple(b)) for b in found)
        rows = [(i, k, at) for k, (_, b) in enumerate(filled) for i, at in zip(b, np.cumsum([0, *(sizes[i] for i in b)]).tolist())]
        at = np.array(rows, dtype=np.int64).reshape(-1, 3)
        out = own.loc[at[:, 0], ["shard", "island", "item", "length"]].reset_index(drop=True)
        count, score = _score(filled)
        ill = sum(fill < FULL * capacity for fill, _ in filled)
        out["bin"], out["offset"], out["loose"] = at[:, 1].astype(np.int32), at[:, 2], at[:, 1] < max(1, min(ill, int(len(filled) * loose)))
        out["bins"], out["score"], out["done"] = count, float(score), count <= least_bins(sizes, capacity)
        return out

    return run


def pack_lengths(items: DataFrame, *, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, herd: int = HERD, loose: float = LOOSE) -> DataFrame:
    """Place items (item: unique, length: 1 to capacity, any others) into sequences of at most ``capacity``.

    Items are dealt by a hash to shards of about ``shard``. Each shard evolves
    on several islands; after each epoch an island's elite also joins the next
    island, and the best of all islands is taken. Only a shard with a packing of
    the least conceivable number of sequences is searched no further. The items
    of the least filled sequences, at most a share ``loose`` of a shard's, form
    fewer shards then, and so on until one is left, which settles all. Adds
    sequence_id and offset. No shards for full items: each is a sequence.
    """
    full = items.where(F.col("length") >= capacity).select(*items.columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    partial = items.where(F.col("length") < capacity)
    left, done, level = partial.select("item", "length"), [], 0
    search = {"generations": generations, "herd": herd}
    while True:
        shards = max(1, -(-left.count() // shard))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
        start = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(-1).alias("bin"), F.lit(False).alias("guest"))
        found = [stash(start.groupBy("shard", "island").applyInPandas(_epoch(capacity, loose, search, 0), _TOLD))]
        for epoch in range(1, epochs):
            done_ = found[-1].where("done").select("shard").distinct()
            open_ = found[-1].join(done_, "shard", "left_anti")
            if open_.isEmpty():
                break
            homes = F.array(F.struct(F.col("island").alias("to"), F.lit(False).alias("guest")), F.struct(((F.col("island") + 1) % islands).cast("int").alias("to"), F.lit(True).alias("guest")))
            homes = open_.select("shard", "item", "length", "bin", F.explode(homes if islands > 1 else F.slice(homes, 1, 1)).alias("h"))
            moved = homes.select("shard", F.col("h.to").alias("island"), "item", "length", "bin", "h.guest")
            found.append(stash(moved.groupBy("shard", "island").applyInPandas(_epoch(capacity, loose, search, epoch), _TOLD)))
        told = reduce(DataFrame.unionByName, [f.withColumn("epoch", F.lit(k)) for k, f in enumerate(found)])
        best = told.groupBy("shard").agg(F.min(F.struct("bins", "score", "epoch", "island")).alias("b")).select("shard", "b.epoch", "b.island")
        placed = stash(told.join(best, ["shard", "epoch", "island"]).select("item", "length", ((F.lit(level).cast("long") * (1 << 58)) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset", "loose"))
        unstash(*found)
        if shards == 1:
            done.append(placed)
            break
        done.append(placed.where("not loose"))
        left, level = placed.where("loose").select("item", "length"), level + 1
    settled = reduce(DataFrame.unionByName, done).select("item", "sequence_id", "offset")
    return full.unionByName(partial.join(settled, "item").select(full.columns))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """Tokenize docs (doc_id, text), cut documents longer than a sequence and pack the pieces.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A null text counts as empty and is its separator
    alone. A text of any length is tokenized whole and cut into pieces. Repeated
    rows and null ids are packed as documents of their own; other columns are
    ignored, and an empty table has no pieces.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = arrow_map(docs, _cut(ranks, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stash(pieces.withColumn("item", F.monotonically_increasing_id()))
    return pack_lengths(pieces, capacity=capacity).drop("item")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences. Null texts are their separator alone; repeated rows are packed apart; long texts are cut, not shortened; no rows give none."""
    return pack(table(spark, sf_dir, "documents"))
