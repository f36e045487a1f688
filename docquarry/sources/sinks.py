"""Sinks: one text file a paper, one JSON array of chunks a file. Names become folders, so writing stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_texts(docs: DataFrame, path: str, name_col: str, text_col: str, mode: str = "overwrite") -> None:
    """``path``/name=.../part-*: the text of each name, as it is; a name with several rows gets several files."""
    docs.select(F.col(name_col).cast("string").alias("name"), F.coalesce(text_col, F.lit("")).alias("value")).write.mode(mode).option("lineSep", "\n").option("maxRecordsPerFile", 1).partitionBy("name").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what write_texts wrote."""
    got = spark.read.schema("value string, name string").text(path, wholetext=True)
    return got.select("name", F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_arrays(chunks: DataFrame, path: str, name_col: str, order_col: str, mode: str = "overwrite") -> None:
    """``path``/name=.../part-*: the chunks of each name as one JSON array, in order. A name's chunks are one document's."""
    row = F.struct(*[c for c in chunks.columns if c != name_col])
    listed = chunks.groupBy(F.col(name_col).cast("string").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("_k"), row.alias("_r")))).alias("_l"))
    value = F.to_json(F.transform("_l", lambda x: x["_r"]), {"ignoreNullFields": "false"})
    listed.select("name", value.alias("value")).write.mode(mode).option("maxRecordsPerFile", 1).partitionBy("name").text(path)
