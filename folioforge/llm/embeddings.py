"""Near-duplicate vectors by sorted projection passes: order by random hashes, compare neighbours, unite the passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_map, components, stash, table, unstash

#: Sign bits of a vector in each pass, least passes, passes sorted at a time (each deals out all vectors once).
BITS, PASSES, TOGETHER = 48, 16, 4
#: Neighbours compared on each side, rows of a run of the order that one task compares, rows of a block of a component
#: (each vector goes to as many tasks as its component has blocks, so these are large), and rows of a tile of a block.
WINDOW, RUN, BLOCK, TILE = 64, 4096, 1024, 256
SEED = 20
#: Chance that all passes miss a pair of the least cosine that stands alone.
MISS = 0.001


def passes_for(rows: int, least: float, window: int) -> int:
    """Passes that miss a lone pair of cosine ``least`` among so many vectors with a chance of about MISS.

    Two vectors meet in a pass if they agree in the log2(rows / window) leading
    bits, after which about a window of vectors is left; each bit agrees with
    the chance of 1 - angle / pi.
    """
    bits = max(0.0, float(np.log2(max(1, rows) / window)))
    met = (1 - np.arccos(least) / np.pi) ** bits
    return max(PASSES, int(np.ceil(np.log(MISS) / np.log1p(-met)))) if met < 1 else PASSES


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision, one row each; all have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of what is left neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signatures(passes: list[int]):
    """For each vector and pass: the signs of BITS random projections as one number, the first the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            column, n = batch.column("embedding"), batch.num_rows
            sizes = np.diff(column.offsets.to_numpy())
            out = np.zeros((len(passes), n), dtype=np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _matrix(column.take(pa.array(rows)))
                for k, p in enumerate(passes):
                    draw = np.random.default_rng([SEED, p, int(size)]).standard_normal((int(size), BITS))
                    out[k, rows] = (x @ draw > 0) @ weights
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(batch.column("node").to_numpy(), len(passes))), pa.array(np.tile(sizes.astype(np.int32), len(passes))), pa.array(np.repeat(np.array(passes, dtype=np.int32), n)), pa.array(out.ravel())],
                names=["node", "size", "pass", "sig"],
            )

    return run


def _chains(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chain of edges along each component of the links a[i] - b[i] between places in nodes."""
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    order = np.lexsort((np.arange(len(nodes)), label))
    join = label[order][1:] == label[order][:-1]
    return nodes[order][:-1][join], nodes[order][1:][join]


def _compare(least: float, window: int):
    """One run of the order in, edges between verified neighbours out."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        node, kind = rows["node"].to_numpy(), rows["pass"].to_numpy().astype(np.int64) << 32 | rows["size"].to_numpy()
        first, second = [], []
        for one in np.unique(kind):
            places = np.flatnonzero(kind == one)
            x = _matrix(rows["embedding"].take(pa.array(places)))
            for lag in range(1, min(window, len(places) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[:-lag], x[lag:]) >= least)
                first.append(places[near])
                second.append(places[near + lag])
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (first, second))
        a, b = _chains(node, a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _count_links(least: float):
    """Two blocks of one component in (or one with itself), links of each vector out."""

    def run(rows: pa.Table) -> pa.Table:
        node, block, copies = (rows[c].to_numpy() for c in ("node", "block", "copies"))
        x = _matrix(rows["embedding"])
        one = block == block.min()
        other = ~one if (~one).any() else one
        links = np.zeros(len(node), dtype=np.int64)
        if int(rows["i"][0].as_py()) == int(rows["j"][0].as_py()) or (~one).any():
            here, there = np.flatnonzero(one), np.flatnonzero(other)
            for at in range(0, len(here), TILE):
                part = here[at : at + TILE]
                near = x[part] @ x[there].T >= least
                if other is one:
                    near[np.arange(len(part)), np.arange(at, at + len(part))] = False
                    links[part] += near @ copies[there]
                else:
                    links[part] += near @ copies[there]
                    links[there] += near.T @ copies[part]
        return pa.table({"node": pa.array(node), "links": pa.array(links)})

    return run


def _ranked(keys: DataFrame) -> DataFrame:
    """Add rank, the place of each row by (pass, size, sig, node): within ranges, plus the rows of the ranges before."""
    order = ["pass", "size", "sig", "node"]
    keys = stash(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = keys.groupBy("range").agg(F.count("*").alias("n"))  # a row per range
    before = sizes.select("range", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return keys.withColumn("place", place).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place") - 1).drop("range", "place", "before")


def near_links(vectors: DataFrame, *, least: float = 0.9, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Edges a, b along the components of verified neighbours in vectors (node, embedding; all valid and different)."""
    found = []
    for at in range(0, passes, TOGETHER):
        some = list(range(at, min(passes, at + TOGETHER)))
        ranked = _ranked(arrow_map(vectors.select("node", "embedding"), _signatures(some), "node long, size int, pass int, sig long"))
        run = F.floor(F.col("rank") / RUN).cast("long")
        # the first rows of a run also end the run before, which compares them with its own last rows
        runs = F.when((F.col("rank") % RUN < window) & (run > 0), F.array(run, run - 1)).otherwise(F.array(run))
        dealt = ranked.select("node", "size", "pass", "rank", F.explode(runs).alias("run")).join(vectors.select("node", "embedding"), "node")
        found.append(stash(dealt.groupBy("run").applyInArrow(_compare(least, window), "a long, b long")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(rows: DataFrame, *, least: float = 0.9, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Links of cosine ``least`` or more among rows (vec_id, embedding), and their components.

    Returns one row per input row: vec_id, n_links (other rows linked
    directly), component_id (the smallest vec_id reachable, itself included),
    kept (vec_id = component_id). Equal vectors are compared once and link with
    each other. The passes, by default as many as passes_for says for the
    vectors there are, find the components: verified neighbours of all passes
    are united. A window is bounded, so the passes alone would miss links
    inside a group larger than it; the exact way for these is to compare all
    vectors of a component, block by block, each task two blocks. Vectors that are null, empty, zero or hold null or non-finite
    components, and vectors of other lengths, link with nothing. A null vec_id
    never names a component and is not kept. Numbers are compared in double
    precision. Other columns are ignored; an empty table stays empty.
    """
    kind = rows.schema["embedding"].dataType.simpleString()
    numbers = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")  # floats are exact as they are
    sound = F.coalesce(
        numbers.isNotNull() & (F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(numbers, lambda x: x != 0), F.lit(False)
    )
    # equal vectors are told by 128 bits and go on as one node, the least of their row numbers
    marks = ["m0", "m1"]
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, numbers).alias("embedding"), F.monotonically_increasing_id().alias("at"))
    given = stash(given.withColumn("m0", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("m1", F.xxhash64(F.lit(1), "embedding")))
    vectors = stash(given.where("m0 is not null").groupBy(*marks).agg(F.min("at").alias("node"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    if passes is None:
        passes = passes_for(vectors.count(), least, window)
    roots = stash(components(near_links(vectors.select("node", "embedding"), least=least, passes=passes, window=window)))

    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    blocks = roots.join(stash(sizes), "root").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    filled = paired.join(vectors.select("node", "embedding", "copies"), "node")
    linked = filled.groupBy("root", "i", "j").applyInArrow(_count_links(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    linked = stash(linked)

    rooted = stash(vectors.select(*marks, "node", "first", "copies").join(roots, "node", "left").select(*marks, "node", "first", "copies", F.coalesce("root", "node").alias("root")))
    names = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    told = stash(rooted.join(names, "root").join(linked, "node", "left").select(*marks, "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    unstash(linked, names)
    # vectors that link with nothing stay out of the join, where they would meet in one task
    found = given.where("m0 is not null").select("vec_id", *marks).join(told, marks).select("vec_id", "n_links", "component_id")
    out = found.unionByName(given.where("m0 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Unsound vectors link with nothing; repeated vectors link with each other; no rows give none."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
