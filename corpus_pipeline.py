"""The corpus pipeline: language identification, exact and near deduplication, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents`` and ignore further ones. An empty table gives an empty
result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import exact_dedup, language_id, mixing, near_dedup, packing
from docquarry.llm.common import stage as staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows, writes the inferred language to ``lang``; rows without a letter (und) go.

    A text that is null or empty has no letter, so it goes. Rows with a null label are not learnt from, null ids and
    sources stay. Repeated rows are learnt from, and kept, each time. Of equal proportions the language first by name wins.
    """
    found = language_id.identify(docs, language_id.train(docs), keep=("text", "source", "n_chars"))
    return found.filter(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after white space is collapsed, the row with the smallest id stays.

    A null text is empty. A null id comes after every other. Of rows that repeat id and text the least row stays.
    """
    return exact_dedup.distinct_documents(docs.select(*COLUMNS))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Texts that are null, empty or without words, and rows without an id, are near to nothing and stay. Rows that share the
    smallest id of a group all stay: an id that repeats is one document. The ids that go are broadcast up to
    ``near_dedup.BROADCAST_IDS``, so the texts stay where they are; beyond, both meet in a shuffled join.
    """
    found = near_dedup.near_duplicates(docs)
    gone = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept")).filter("NOT _kept").select("_id")
    gone = staged(gone, "near-gone")
    gone = F.broadcast(gone) if gone.count() <= near_dedup.BROADCAST_IDS else gone
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("_id"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where a source's target ends inside a document, its text is cut.

    Texts without words (null, empty) are never taken. A null source is a source of its own, null ids are kept. Repeated
    rows are taken each for itself; ties in the shuffled order go to the smaller id. The rows come in no order: packing
    doesn't depend on it, and op10 has each document's first slot.
    """
    return mixing.mixed_documents(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: one row per piece, with its ids, its sequence and its offset there.

    A null or empty text is its end token alone, a null id is kept. Repeated rows are documents of their own. Pieces of one
    length are interchangeable: they take their places in the order of tasks and rows.
    """
    return packing.pack(docs, packing.default_tokenizer(), with_ids=True)


STAGES = [("language ID", identify_language), ("exact dedup", drop_exact), ("MinHash near-dedup", drop_near), ("mix sources", mix), ("pack", pack)]

#: SQL has no expectation-maximisation, MinHash or linear program: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = staged(f(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
