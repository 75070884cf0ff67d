"""The corpus pipeline: toxic documents go, then near-duplicates, repeated passages and secrets; the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import packing, secrets, simhash, substrings, toxicity
from folioforge.llm.common import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents: extra ones go, whatever their names, and those that are not there are null."""
    kinds = dict.fromkeys(COLUMNS, "string") | {"doc_id": "bigint", "n_chars": "bigint"}
    return docs.select(*(F.col(c) if c in docs.columns else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS))


def _recounted(docs: DataFrame) -> DataFrame:
    return _documents(docs.withColumn("n_chars", F.length("text").cast("long")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    The model is fitted on labelled rows of docs that are not held out; without
    labels of both kinds every score is below 0.5 and all stay. Null, empty and
    blank texts stay, repeated rows are judged alike, long texts whole; an empty
    table stays empty. Extra columns go, here and in each stage.
    """
    docs = _documents(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model, spans=False).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by a Jaccard similarity of 0.8 of five-word shingles: the least doc_id.

    Null, empty and blank texts are one group. Of repeated rows one stays; rows
    with a null doc_id all stay. Whole texts count; an empty table stays empty.
    """
    return simhash.keep_one(_documents(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that a repeated window of 35 words covers, in all its places.

    Texts that lose nothing stay as they are, null ones become empty. Repeated
    rows of 35 words or more lose them all. n_chars is counted anew.
    """
    return _recounted(substrings.substring_dedup(_documents(docs)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark. Null texts stay null; repeated rows are judged alike. n_chars is counted anew."""
    return _recounted(secrets.redact(_documents(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens. A null or empty text is its separator alone; each repeated row has its own pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Model fitting, similarity components and tokenization have no SQL; tests compare run() with the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
