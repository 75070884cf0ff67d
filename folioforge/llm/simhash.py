"""Near-duplicate documents by SimHash: pigeonhole blocks, join on blocks, verify Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from folioforge.llm.common import arrow_map, as_bytes, components, stash, table, unstash

SEED = 42
#: Groups above this many fingerprints get finer blocks before they are compared.
GROUP = 4096


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bit b is 1 if it is set in over half the XXH64 of the text's word shingles; no words: 0."""
    words = (text or b"").lower().split()  # for bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(blocks: int, distance: int) -> list[tuple[int, list[int]]]:
    """For each choice of ``distance`` blocks that may differ: the mask of the others, and finer masks.

    The finer masks cut the free bits into blocks of four again, so that at
    most 4 * distance bits stay free: a group under a finer mask holds at most
    2 ** (4 * distance) different fingerprints, whatever the corpus.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    out = []
    for free in combinations(range(blocks), distance):
        loose = [b for i in free for b in range(cuts[i], cuts[i + 1])]
        nibbles = [sum(1 << b for b in loose[i : i + 4]) for i in range(0, len(loose), 4)]
        open_bits = sum(bits[i] for i in free)
        full = (1 << 64) - 1
        finer = [full ^ sum(part) for part in combinations(nibbles, distance)]
        out.append((full ^ open_bits, finer))
    return out


def _chains(distance: int):
    """Fingerprints of one group in, edges out: a chain along each of its components."""

    def chain(group: np.ndarray) -> list[tuple[int, int]]:
        left, out = np.sort(group), []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    found, left = left[near], left[~near]
                    out += zip([x, *found[:-1]], found)
                    todo += list(found)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            ends = ends - ends[0]
            edges = [e for lo, hi in zip(ends, ends[1:]) for e in chain(flat[lo:hi])]
            pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def links(prints: DataFrame, *, blocks: int = 6, distance: int = 3, group: int = GROUP) -> DataFrame:
    """Edges a, b between different fingerprints (column fp, distinct) that connect all pairs within ``distance`` bits.

    Two fingerprints within ``distance`` bits agree on all but ``distance`` of
    the blocks, so they meet under one of the masks. Groups of more than
    ``group`` fingerprints are dealt out once more by finer masks, which bounds
    them at 4096 for distance 3. In each group the verified pairs are reduced
    to a chain along each component, so rows stay linear in the group.
    """
    masks = _masks(blocks, distance)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, (m, _) in enumerate(masks)])).alias("k"))
    keyed = keyed.select("fp", "k.choice", "k.part")
    sizes = stash(keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1"))
    shared = keyed.join(sizes, ["choice", "part"])
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in more]) for _, more in masks])
    small = shared.where(F.col("n") <= group).select("fp", "choice", F.lit(-1).alias("sub"), "part")
    large = (
        shared.where(F.col("n") > group)
        .select("fp", "choice", F.posexplode(F.element_at(finer, F.col("choice") + 1)).alias("sub", "mask"))
        .select("fp", "choice", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    )
    groups = small.unionByName(large).groupBy("choice", "sub", "part").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    return arrow_map(groups, _chains(distance), "a long, b long")


def simhash(docs: DataFrame, *, width: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of docs (doc_id, text).

    Returns one row per input row: doc_id, fp (BIGINT), component_id (the
    smallest doc_id reachable by links of at most ``distance`` bits). A null,
    empty or blank text has fingerprint 0 and links like any other. Equal rows
    each stay. A null doc_id keeps its row and its links but never names a
    component; a component of null ids only has a null id. Long texts count
    whole. Other columns of docs are ignored; an empty table stays empty.
    """
    spark = docs.sparkSession
    prints = stash(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _fingerprints(width), "doc_id long, fp long"))
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = stash(links(distinct.select("fp"), blocks=blocks, distance=distance))
    roots = components(edges)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted)
    least = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stash(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: For similarity: words of 64 sign bits a document, least shingles of a document that serve as its keys.
WIDE, KEYS = 3, 10
#: Sign bits that may differ in a pair to be verified: from SHORT shingles on, and below. At Jaccard 0.8 the mean is
#: 29 and 5.0 the deviation; of few shingles up to 36 and 5.4. Either limit lies five deviations off.
SHORT, FAR, FAR_SHORT = 64, 54, 63
#: Rows of a key compared in one place; shingles of such rows, where whole sets are compared.
BLOCK, SHINGLES = 2048, 500_000
#: Chance that two similar documents share none of their new keys; share of crowded shingles from which these are the whole prefix.
LOST, OFTEN = 1e-14, 0.1
#: Documents up to which the wanted ones are broadcast to pick their sets (8 bytes each); more are joined.
FEW = 1_000_000
#: Crowded shingles up to which they are sent to all tasks (8 bytes each); more are joined.
CROWDED = 1_000_000
#: Candidates of a document in one group that are named as pairs; of those with more, whole sets meet in one place.
NAMED = 16
#: Keys of a document that are listed beside it, so that a pair is compared under its first common one of these only.
LISTED = 16


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The different XXH64 of the text's word shingles, ascending; of fewer words than width all are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=max(1, len(words) - width + 1)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE * 64 sign bits of different shingles; each word of bits mixes their XXH64 anew."""
    n = len(hashes)
    ones = np.zeros((WIDE, 64), dtype=np.int64)
    lanes = np.uint64(0x0101010101010101)
    for k in range(WIDE):
        for at in range(0, n, 255):  # a lane of eight bits counts to 255
            part = hashes[at : at + 255]
            for bit in range(8):
                ones[k, bit::8] += np.add.reduce((part >> np.uint64(bit)) & lanes, dtype=np.uint64, keepdims=True).view(np.uint8)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _prefix(n: int, similarity: float) -> int:
    """So many first shingles, in any one order of all: two sets that are similar share one of them."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _shingled(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in as_bytes(batch.column("text"))]
            marks = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes(), SEED) for s in sets), dtype=np.int64).reshape(-1, 2)
            bits = np.array([wide_fingerprint(s) for s in sets], dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            keys = _lists([s[: min(KEYS, _prefix(len(s), similarity))] for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(bits[:, k]) for k in range(WIDE)), keys, _lists(sets)],
                names=["doc_id", "row", "m0", "m1", "n", *FS, "keys", "shingles"],
            )

    return run


@cache
def _enough(n: int, rare: int, similarity: float) -> int:
    """So many first shingles, crowded ones last, of n, of which ``rare`` are not crowded: a similar set has one of them.

    A similar set lacks few of the n. That it lacks all the first m rare ones,
    which XXH64 has put into any order, has a chance below LOST at the m
    returned, and none at that of the whole prefix. Documents with many crowded
    shingles get their whole prefix.
    """
    whole = _prefix(n, similarity)
    if rare < (1 - OFTEN) * n:
        return whole
    chance = 1.0
    for m in range(whole):
        if chance <= LOST:
            return m
        chance *= (whole - 1 - m) / (rare - m) if m < rare else 1.0
    return whole


def _rare(batch: pa.RecordBatch, crowded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's shingles, and which are not crowded: neither among ``crowded`` nor in the row's own list."""
    lists, lates = batch.column("shingles"), batch.column("late")
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    late, stops = lates.flatten().to_numpy(zero_copy_only=False), lates.offsets.to_numpy()
    often = np.isin(flat, crowded)
    ends, stops = ends - ends[0], stops - stops[0]
    for lo, hi, at, to in zip(ends, ends[1:], stops, stops[1:]):
        yield flat[lo:hi], ~(often[lo:hi] | np.isin(flat[lo:hi], late[at:to]))


def _rekeyed(crowded: np.ndarray, similarity: float):
    """Shingle sets in, enough keys of each out, in an order that puts crowded shingles last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for own, rare in _rare(batch, crowded):
                enough = _enough(len(own), int(rare.sum()), similarity)
                keys.append(np.concatenate([own[rare], own[~rare]])[:enough].view(np.uint64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["node", "n", *FS]), _lists(keys)], names=["node", "n", *FS, "keys"])

    return run


def _looked(crowded: np.ndarray, similarity: float, depth: int):
    """Shingle sets in, out with them ``depth`` times enough shingles that are not crowded, but those before the place ``at``, and the new place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = [], []
            for (own, rare), at in zip(_rare(batch, crowded), batch.column("at").to_pylist()):
                where = np.flatnonzero(rare)
                deep = _enough(len(own), len(where), similarity) * depth
                to = max(at, int(where[deep]) if deep < len(where) else len(own))
                keys.append(own[where[(where >= at) & (where < to)]].view(np.uint64))
                places.append(to)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("shingles"), pa.array(places, pa.int32()), _lists(keys)], names=["node", "shingles", "at", "keys"])

    return run


def _deeper(found: np.ndarray):
    """Rows in; out those with a found shingle before the place ``at`` and others behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [at < len(own) and not rare[:at].all() for (own, rare), at in zip(_rare(batch, found), batch.column("at").to_pylist())]
            yield batch.select(["node", "shingles", "at"]).filter(pa.array(more, pa.bool_()))

    return run


def _beside(hot: DataFrame, crowded: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Crowded shingles for all tasks, or if these are too many, each document's own in its column ``late``."""
    none = F.array().cast("array<long>")
    if crowded.count() <= CROWDED:
        return np.array([r.key for r in crowded.collect()], dtype=np.int64), hot.withColumn("late", none)
    late = hot.select("node", F.explode("shingles").alias("key")).join(crowded, "key").groupBy("node").agg(F.collect_list("key").alias("late"))
    return np.zeros(0, dtype=np.int64), hot.join(late, "node", "left").withColumn("late", F.coalesce("late", none))


def _anew(hot: DataFrame, crowded: DataFrame, similarity: float) -> DataFrame:
    """A row for each key (see _rekeyed) of hot documents with their sets: node, n, sign bits, key."""
    own = ["node", "n", *FS]
    names, hot = _beside(hot, crowded)
    schema = "node long, n int, " + ", ".join(f"{f} long" for f in FS) + ", keys array<long>"
    return arrow_map(hot.select(*own, "shingles", "late"), _rekeyed(names, similarity), schema).select(*own, F.explode("keys").alias("key"))


def _crowded(hot: DataFrame, known: DataFrame, similarity: float, block: int) -> DataFrame:
    """Shingles that more than ``block`` hot documents would have as keys: those known, and what comes up in their places.

    Only the shingles that would be keys are counted, not whole sets.
    Documents with a crowded one among them are looked at again, twice as deep,
    from the place where the last look ended: as sets are in order, each
    shingle of a document is counted once at most, however many are crowded.
    """
    schema = "node long, shingles array<long>, at int"
    left, depth, last, counts = hot.select("node", "shingles", F.lit(0).alias("at")), 1, None, None
    while True:
        names, rows = _beside(left, known)
        looked = stash(arrow_map(rows.select("node", "shingles", "at", "late"), _looked(names, similarity, depth), f"{schema}, keys array<long>"))
        if last:
            unstash(last)
        now = looked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size"))
        if counts:
            now = now.unionByName(counts.where(F.col("size") <= block)).groupBy("key").agg(F.sum("size").alias("size"))
        now = stash(now)
        if counts:
            unstash(counts)
        found = stash(now.where(F.col("size") > block).select("key"))
        if found.isEmpty():
            unstash(looked, now, found)
            return known
        more = stash(known.unionByName(found))
        names, rows = _beside(looked.select("node", "shingles", "at"), found)
        # stored, so that no task runs two Python steps, each in a worker of its own that stays
        left = stash(arrow_map(rows, _deeper(names), schema))
        unstash(looked)
        known, last, counts, depth = more, left, now, 2 * depth


FS = [f"f{k}" for k in range(WIDE)]
#: What names a key: 1 for keys anew, and the shingle. What names a group: two chunks of the key's rows beside it.
KEY = ["anew", "key"]
GROUPED = [*KEY, "i", "j"]


def _near(n: np.ndarray, bits: np.ndarray, x_n: int, x_bits: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows may be similar to a row x, by size (exactly) and sign bits."""
    size = np.minimum(n, x_n) >= similarity * np.maximum(n, x_n) - 1e-9
    far = np.where((n < SHORT) | (x_n < SHORT), FAR_SHORT, FAR)
    return size & (np.bitwise_count(bits ^ x_bits).sum(axis=1) <= far)


def _members(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The place in the batch and the rows of each group."""
    lists = batch.column("members")
    rows, ends = lists.flatten(), lists.offsets.to_numpy()
    columns = {rows.type.field(i).name: c.to_numpy(zero_copy_only=False) for i, c in enumerate(rows.flatten())}
    columns["bits"] = np.stack([columns.pop(f) for f in FS], axis=1).view(np.uint64)  # of a negative number, bitwise_count takes the absolute value
    for place, (lo, hi) in enumerate(zip(ends - ends[0], ends[1:] - ends[0])):
        yield place, {name: c[lo:hi] for name, c in columns.items()}


def _gathered(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*GROUPED).agg(F.collect_list(F.struct("node", "n", *FS, *more)).alias("members")).where("size(members) > 1")


def _middle(bits: np.ndarray) -> np.ndarray:
    """Of each row, the sign bits that differ from those of most rows."""
    ones = np.unpackbits(bits.view(np.uint8), axis=1).mean(axis=0) > 0.5
    return np.bitwise_count(bits ^ np.packbits(ones).view(np.uint64)).sum(axis=1)


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in, the row in the middle of each out, and how far from the middle it is."""
    for batch in batches:
        places, found = [], []
        for place, g in _members(batch):
            off = _middle(g["bits"])
            at = np.lexsort((g["node"], off))[0]
            places.append(place)
            found.append((g["node"][at], g["n"][at], *g["bits"][at].view(np.int64), off[at]))
        at, values = pa.array(places, pa.int64()), np.array(found, dtype=np.int64).reshape(-1, WIDE + 3)
        columns = [pa.array(values[:, 0]), pa.array(values[:, 1].astype(np.int32)), *(pa.array(values[:, 2 + k]) for k in range(WIDE)), pa.array(values[:, -1])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in KEY), *columns], names=[*KEY, "node", "n", *FS, "off"])


def _stars(similarity: float):
    """Groups in, out a pair for each row that may be similar to the row of its star: the one in the middle of those left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, first, second, far = [], [], [], []
            for place, g in _members(batch):
                left = np.lexsort((g["node"], ~g["given"]))
                given = int(g["given"].sum())  # the key's own pivot, if it has one, comes before those of the block
                while len(left) > 1:
                    bits = g["bits"][left]
                    x = left[0] if given else left[np.argmin(_middle(bits))]
                    given = max(0, given - 1)
                    rest = left[g["node"][left] != g["node"][x]]
                    near = _near(g["n"][rest], g["bits"][rest], g["n"][x], g["bits"][x], similarity)
                    found, left = rest[near], rest[~near]
                    places += [place] * len(found)
                    first += g["node"][found].tolist()
                    second += [int(g["node"][x])] * len(found)
                    far += np.bitwise_count(g["bits"][found] ^ g["bits"][x]).sum(axis=1).tolist()
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in KEY), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(far, pa.int32())], names=[*KEY, "a", "b", "far"]
            )

    return run


def _before(keys: np.ndarray, key: int) -> np.ndarray:
    """For each row its listed keys below this one, a row of a matrix filled up with the greatest number."""
    out = np.full((len(keys), LISTED), key_none, dtype=np.int64)
    for row, own in zip(out, keys):
        own = own[own < key]
        row[: len(own)] = own
    return out


key_none = np.iinfo(np.int64).max


def _apart(similarity: float):
    """Groups in; out each pair of rows of different components that may be similar and has a guest in it.

    If a guest has more than NAMED such partners, the rows of these pairs come
    out alone, to meet with whole sets in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, nodes, others, guests = [], [], [], []
            for place, g in _members(batch):
                hosts, visits = np.flatnonzero(~g["guest"]), np.flatnonzero(g["guest"])
                if not len(visits):  # all of the key is here
                    visits = np.flatnonzero(g["root"] != g["main"])
                dense_hosts, dense_guests = set(), set()
                before = _before(g["keys"], batch.column("key")[place].as_py())
                for x in visits:
                    near = _near(g["n"][hosts], g["bits"][hosts], g["n"][x], g["bits"][x], similarity) & (g["root"][hosts] != g["root"][x])
                    found = hosts[near]
                    own = before[x][before[x] != key_none]
                    found = found[~np.isin(before[found], own).any(axis=1)]  # those pairs meet under an earlier key
                    if len(found) > NAMED:
                        dense_guests.add(int(g["node"][x]))
                        dense_hosts.update(g["node"][found].tolist())
                    else:
                        places += [place] * len(found)
                        nodes += [int(g["node"][x])] * len(found)
                        others += g["node"][found].tolist()
                        guests += [True] * len(found)
                for rows, guest in ((sorted(dense_guests), True), (sorted(dense_hosts), False)):
                    places += [place] * len(rows)
                    nodes += rows
                    others += [None] * len(rows)
                    guests += [guest] * len(rows)
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in GROUPED), pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(guests, pa.bool_())], names=[*GROUPED, "node", "other", "guest"]
            )

    return run


def _verified(similarity: float):
    """Rows by star, the center of each first; out the pairs of a row and its center that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, None
        for batch in batches:
            node, star, middle = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "star", "center"))
            lists = batch.column("shingles")
            flat, ends, good = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), []
            for k in range(batch.num_rows):
                shingles = flat[ends[k] : ends[k + 1]]
                if middle[k]:
                    center, own = star[k], shingles.copy()
                    continue
                assert center == star[k]
                both = len(np.intersect1d(shingles, own, assume_unique=True))
                if both >= similarity * (len(shingles) + len(own) - both) - 1e-9:
                    good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(node[good]), pa.array(star[good])], names=["a", "b"])

    return run


def _across(similarity: float):
    """One group with shingle sets in, out edges that connect its components wherever a guest and a host of two are similar."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, root, n = (rows[c].to_numpy().copy() for c in ("node", "root", "n"))
        guest = rows["guest"].to_numpy(zero_copy_only=False)
        bits = np.stack([rows[f].to_numpy() for f in FS], axis=1).view(np.uint64)
        names, ids = np.unique(rows["shingles"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        starts = np.cumsum([0, *n])
        hosts, edges = np.flatnonzero(~guest), []
        for x in np.flatnonzero(guest):
            near = hosts[_near(n[hosts], bits[hosts], n[x], bits[x], similarity) & (root[hosts] != root[x])]
            if not len(near):
                continue
            mark = np.zeros(len(names), dtype=bool)
            mark[ids[starts[x] : starts[x + 1]]] = True
            for y in near:
                both = int(mark[ids[starts[y] : starts[y + 1]]].sum()) if root[y] != root[x] else 0
                if both and both >= similarity * (n[x] + n[y] - both) - 1e-9:
                    edges.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
        a, b = np.array(edges, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _keyed(distinct: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Rows anew, key, node, n, sign bits, size: any two similar documents share a key, and only shared keys are there.

    The keys are a document's least shingles. The least shingle that two
    similar ones share is among the first KEYS of both unless KEYS of only one
    come before, 0.2 ** KEYS at 0.8. Documents with a crowded key, one that
    more than ``block`` have, get new ones besides, in an order that puts
    crowded shingles last: as many as leave a pair a chance of LOST to share
    none (some 20, however long the document), or the whole prefix.
    """
    own = ["node", "n", *FS]
    keyed = distinct.select(*own, F.explode("keys").alias("key"))
    sizes = stash(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = keyed.join(sizes, "key")
    out = shared.where(F.col("size") <= block).select(F.lit(0).alias("anew"), "key", *own, "size")
    if sizes.where(F.col("size") > block).isEmpty():
        return stash(out)
    wanted = _sets_of(shared.where(F.col("size") > block).select("node"), sets)
    hot = stash(_with_sets(distinct.select(*own), wanted))
    unstash(wanted)
    crowded = _crowded(hot, sizes.where(F.col("size") > block).select("key"), similarity, block)
    anew = stash(_anew(hot, crowded, similarity))
    unstash(crowded, hot)
    anew = anew.join(stash(anew.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")), "key")
    return stash(out.unionByName(anew.select(F.lit(1).alias("anew"), "key", *own, "size")))


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node and others) with the shingles of node."""
    return rows.join(sets, "node")


def _sets_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of nodes. So that the sets that nobody asks for are not dealt out, the nodes are broadcast if they are few."""
    nodes = stash(nodes.distinct())
    return stash(sets.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node", "left_semi"))


def _check_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the different pairs a, b that are similar.

    All a of one b are read in a row behind the set of b; those of a popular b
    are dealt out to parts, each behind a copy of it.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    centers = parts.select(F.col("b").alias("node"), F.col("b").alias("star"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("center"))
    popular = stash(parts.where("parts > 1"))
    rows = pairs.join(popular, "b", "left").select(F.col("a").alias("node"), F.col("b").alias("star"), F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(False).alias("center"))
    placed = _with_sets(rows.unionByName(centers), sets).repartition("star", "part").sortWithinPartitions("star", "part", F.desc("center"))
    return stash(arrow_map(placed, _verified(similarity), "a long, b long"))


def _meetings(rows: DataFrame, roots: DataFrame, tried: DataFrame, block: int) -> DataFrame:
    """Rows of groups in which all pairs of a key that are in different components meet: GROUPED, node, n, bits, root, main, guest.

    Only keys of which some rows may be similar, and that are in more than one
    block or component, are there. The guests are the rows outside the key's
    largest component: each such pair has one. Where a key's rows or guests
    exceed a block, each block of rows meets each block of guests.
    """
    named = rows.join(tried, KEY, "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stash(named)
    lists = named.groupBy("anew", "node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LISTED).alias("keys"))
    by_root = named.groupBy(*KEY, "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    keys = by_root.groupBy(*KEY).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("c"), F.max("c").alias("most"), F.sum("w").alias("w"), F.count("*").alias("roots")).where("roots > 1")
    share = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block), F.ceil(F.col("w") * F.col(c) / F.col("c") / SHINGLES)).cast("int")
    keys = stash(keys.withColumn("guests", F.col("c") - F.col("most")).withColumn("is", share("c")).withColumn("js", share("guests")).select(*KEY, "main", "is", "js"))
    met = named.join(keys, KEY).join(lists, ["anew", "node"])
    own = ["node", "n", *FS, "root", "main", "keys"]
    hosts = met.withColumn("i", F.pmod(F.xxhash64("node", "key"), F.col("is")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1)))
    guests = met.where("(is > 1 or js > 1) and root <> main").withColumn("j", F.pmod(F.xxhash64("key", "node"), F.col("js")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("is") - 1)))
    return hosts.select(*GROUPED, *own, F.lit(False).alias("guest")).unionByName(guests.select(*GROUPED, *own, F.lit(True).alias("guest")))


def similar(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Documents that share a key (see _keyed) and may be similar by size and by
    WIDE * 64 sign bits are verified on their whole shingle sets. First a star
    around the middle of each group is verified, which settles groups of
    copies in linear time; then all pairs of a key that are in different
    components still. Returns one row per input row: doc_id, row,
    component_id. row is that of docs, if it has this column, or null. Nulls,
    blanks and ties as in simhash.
    """
    row = F.col("row") if "row" in docs.columns else F.lit(None)
    schema = "doc_id long, row long, m0 long, m1 long, n int, " + ", ".join(f"{f} long" for f in FS) + ", keys array<long>, shingles array<long>"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    prints = stash(arrow_map(given, _shingled(width, similarity), schema).withColumn("node", F.monotonically_increasing_id()))
    # equal sets are told by 128 bits and go on as one node, the least of their row numbers
    marks = ["m0", "m1"]
    distinct = stash(prints.groupBy(*marks).agg(F.min("node").alias("node"), F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ["n", *FS, "keys"])))
    sets = prints.select("node", "shingles")
    rows = _keyed(distinct, sets, similarity, block).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")).withColumn("j", F.lit(0))

    starred = rows.withColumn("given", F.lit(False))
    large = rows.where("blocks > 1")
    many = not large.isEmpty()
    if many:  # a key in several blocks has one pivot for all
        own = ["node", "n", *FS]
        pivots = arrow_map(_gathered(large), _pivots, "anew int, key long, node long, n int, " + ", ".join(f"{f} long" for f in FS) + ", off long")
        pivots = pivots.groupBy(*KEY).agg(F.min_by(F.struct(*own), F.struct("off", "node")).alias("p"))
        spread = large.groupBy(*KEY).agg(F.max("blocks").alias("blocks")).join(pivots, KEY).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        starred = starred.select(*GROUPED, *own, "given").unionByName(spread.select(*KEY, "i", F.lit(0).alias("j"), *(F.col(f"p.{c}").alias(c) for c in own), F.lit(True).alias("given")))
    near = stash(arrow_map(_gathered(starred, "given"), _stars(similarity), "anew int, key long, a long, b long, far int"))
    # one star for each row, the nearest
    pairs = stash(near.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")))
    wanted = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), sets)
    edges = _check_pairs(pairs, wanted, similarity)
    unstash(wanted)
    tried = near.select(*KEY)
    tried = stash((tried.unionByName(large.select(*KEY)) if many else tried).distinct())
    unstash(near, pairs)
    roots = stash(components(edges))

    met = stash(_meetings(rows, roots, tried, block))
    open_ = stash(arrow_map(_gathered(met, "root", "main", "guest", "keys"), _apart(similarity), "anew int, key long, i int, j int, node long, other long, guest boolean"))
    unstash(met, tried)
    if not open_.isEmpty():
        pairs = open_.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        sets = _sets_of(open_.select(F.explode(F.array("node", "other")).alias("node")).where("node is not null"), sets)
        edges = edges.unionByName(_check_pairs(stash(pairs), sets, similarity))
        roots = stash(components(edges))
        dense = open_.where("other is null").join(distinct.select("node", "n", *FS), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if not dense.isEmpty():
            more = stash(_with_sets(dense, sets).groupBy(*GROUPED).applyInArrow(_across(similarity), "a long, b long"))
            roots = stash(components(edges.unionByName(more)))
    rooted = stash(distinct.join(roots, "node", "left").select(*marks, "first", F.coalesce("root", "node").alias("root")))
    least = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stash(rooted.join(least, "root").select(*marks, "component_id"))
    return prints.select("doc_id", "row", *marks).join(named, marks).select("doc_id", "row", "component_id")


def keep_one(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Drop all but one document of each near-duplicate component: the one with the smallest doc_id.

    If several rows have that doc_id, the one whose columns hash to the least
    number stays, and of equal rows one. Rows with a null doc_id all stay, as
    they cannot be named. Null and blank texts are copies of each other. Columns
    are those of docs; none may be a map.
    """
    row = F.xxhash64(*(f"`{c}`" for c in docs.columns))
    found = similar(docs.select("doc_id", "text", row.alias("row")), width=width, similarity=similarity)
    keep = stash(found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("row").alias("_row"), F.count("*").alias("n")))
    marked = docs.withColumn("_row", row)
    kept = marked.join(keep.where("n = 1"), ["doc_id", "_row"], "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.unionByName(marked.join(keep.where("n > 1"), ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"]))
    return kept.unionByName(marked.where("doc_id is null")).select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints (16 hex digits) and components of all documents. Null, empty and blank texts: fingerprint zero; repeated rows each stay; long texts count whole; no rows give none."""
    out = simhash(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
