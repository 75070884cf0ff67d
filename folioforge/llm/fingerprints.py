"""Document fingerprints: threshold-scaled sketches that stay comparable however unequal the documents are.

Only DataFrame functions here: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import prepare, stash, table

#: A hash is kept if its first FRACTION_BITS bits are zero: one in eight.
FRACTION_BITS = 3


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once for each row, not once for each element of an inner loop."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, *, width: int = 5, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sorted hashes (array of BIGINT) of the text's word shingles that are below a fixed fraction of all hashes.

    Fewer words than ``width`` make one shingle. A text with words none of
    whose hashes is below the fraction keeps its least one; a null or blank
    text has an empty sketch. Sketches of several texts merge with merged.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D ]+"), lambda w: w != "")
    # The sign bit is cleared: hashes are 63-bit, so fraction_bits counts from the second bit.
    low = (1 << 63) - 1

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]).bitwiseAND(F.lit(low)))
        few = F.transform(F.array(h), lambda whole: F.xxhash64(whole).bitwiseAND(F.lit(low)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < width, few).otherwise(many)

    def kept(hashes: Column) -> Column:
        below = F.filter(hashes, lambda x: x < (1 << (63 - fraction_bits)))
        return _bind(below, lambda b: F.when((F.size(b) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.array_sort(F.array_distinct(b))))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _bind(shingles(h), kept))


def merged(a: Column, b: Column, *, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sketch of all shingles of two texts from their sketches.

    Their union; a least hash that is kept though it is above the fraction
    goes if any is below it, and else the lesser one stays.
    """
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < (1 << (63 - fraction_bits)))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return _bind(both, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; all, if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def spelled(sketch_column: Column) -> Column:
    """Sixteen hex digits for each hash."""
    return F.array_join(F.transform(sketch_column, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprint(docs: DataFrame, *, width: int = 5, fraction_bits: int = FRACTION_BITS) -> DataFrame:
    """Columns of docs plus sketch; a column of that name is replaced.

    Null, empty and blank texts have an empty sketch; texts of any length count
    whole. Rows are judged alone, repeated ones too; an empty table stays empty.
    """
    return docs.withColumn("sketch", sketch(F.col("text").cast("string"), width=width, fraction_bits=fraction_bits))


def _successors(docs: DataFrame) -> DataFrame:
    """For each different (doc_id, mark) of docs: the one before it by descending doc_id, whose third the edit takes from it.

    Nulls come last, then the first follows again. Ids are dealt by range, so
    the order is found within each range and over the ranges' first and last
    ids; no task sees all of them.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    ids = docs.groupBy("doc_id", "mark").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    ids = stash(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*order)
    own = F.struct("doc_id", "mark", "n_chars")
    ranked = ids.withColumn("before", F.lag(own).over(within)).withColumn("place", F.row_number().over(within))
    # a row per range from here on
    last = ids.groupBy("range").agg(F.max_by(own, F.struct(F.col("doc_id").isNull().alias("a"), F.bitwise_not("doc_id").alias("b"), F.col("mark").alias("c"))).alias("last"))
    whole = Window.partitionBy(F.lit(0)).orderBy("range")
    last = last.withColumn("previous", F.coalesce(F.lag("last").over(whole), F.last("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("range", "previous")
    out = ranked.join(F.broadcast(last), "range")  # as many rows as shuffle partitions
    return out.select("doc_id", "mark", "copies", F.when(F.col("place") == 1, F.col("previous")).otherwise(F.col("before")).alias("before"))


def neighbours(docs: DataFrame, *, width: int = 5, fraction_bits: int = FRACTION_BITS) -> DataFrame:
    """Compare each text of docs (doc_id, text) with an edit of it and with the next document.

    The edit replaces the last third of its code points, rounded down, by as
    many, or all, from the start of the next document by descending doc_id
    (after the last: the first). Returns doc_id, n_chars, edited_sha256,
    sketch, edited_sketch, near_edited, near_next, one row for each input row.
    Null texts count as empty. Null ids come last in the order; rows of one
    doc_id are ordered by a hash of their texts, and equal rows share a place,
    so that their next document is the next different one. A document on its
    own is its own next one. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    following = stash(_successors(docs.select("doc_id", "mark", F.length("text").cast("long").alias("n_chars"))))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])

    source = docs.alias("source")
    given = source.join(following, same(source, following)).select(
        F.col("before.doc_id").alias("doc_id"), F.col("before.mark").alias("mark"), source["doc_id"].alias("next_id"), source["mark"].alias("next_mark"),
        F.substring(source["text"], F.lit(1), F.floor(F.col("before.n_chars") / 3).cast("int")).alias("head"),
    )
    if not following.where("copies > 1").isEmpty():
        given = given.dropDuplicates(["doc_id", "mark"])
    edit = F.concat(F.substring(docs["text"], F.lit(1), (F.length(docs["text"]) - F.floor(F.length(docs["text"]) / 3)).cast("int")), "head")
    edited = docs.join(given, same(docs, given)).select(docs["doc_id"], docs["mark"], "next_id", "next_mark", "text", edit.alias("edited"))
    options = {"width": width, "fraction_bits": fraction_bits}
    sketched = stash(
        edited.select(
            "doc_id", "mark", "next_id", "next_mark", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            sketch(F.col("text"), **options).alias("sketch"), sketch(F.col("edited"), **options).alias("edited_sketch"),
        )
    )
    others = sketched.select(F.col("doc_id").alias("o_id"), F.col("mark").alias("o_mark"), F.col("sketch").alias("o_sketch"))
    if not following.where("copies > 1").isEmpty():
        others = others.dropDuplicates(["o_id", "o_mark"])
    return sketched.join(others, sketched["next_id"].eqNullSafe(others["o_id"]) & (sketched["next_mark"] == others["o_mark"])).select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("o_sketch")).alias("near_next")
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edits, and their likeness. Null texts count as empty; repeated rows each stay; long texts count whole; no rows give none."""
    out = neighbours(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", spelled(F.col("sketch")).alias("fingerprint"), spelled(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
