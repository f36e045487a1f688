"""Plain-text chunking: paragraphs, sentence-aware splitting, size-bounded packing with overlap, section tracking.

Paragraphs, splitting and packing are folds over a document (see folds), in Arrow batches. A document never leaves its
row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.layout import spread
from . import folds

VERSION = "pptxt-0.1"


def paragraphs(text: Column | str) -> Column:
    """array(struct(start, end, text, hint)): see folds.paragraphs."""
    names = ("start", "end", "text", "hint")
    one = lambda s: s.map(lambda t: [dict(zip(names, p, strict=True)) for p in folds.paragraphs(t or "")])
    return F.pandas_udf(one, "array<struct<start:int,end:int,text:string,hint:string>>")(text)


def split_long(text: Column | str) -> Column:
    """Segments of at most MAX characters, at sentence ends where possible, else between words."""
    return F.pandas_udf(lambda s: s.map(lambda t: folds.segments(t or "")), "array<string>")(text)


_RAW = "file string, idx int, id string, section string, start_line int, end_line int, text string, before string, after string"
_LINK = "array<struct<id:string,direction:string>>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("file", "idx", "id", "section", "start_line", "end_line", "text", "before", "after")
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for file, stem, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows = list(folds.text_chunks(text or ""))
            ids = [f"{stem}::L{first}-{last}::c{k}" for k, _, first, last, _ in rows]
            for at, (k, section, first, last, body) in enumerate(rows):
                own = (file, k, ids[at], section, first, last, body, ids[at - 1] if at else None, ids[at + 1] if at + 1 < len(ids) else None)
                for col, x in zip(cols, own, strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))


def chunk(docs: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """Raw chunks, one row each: file, idx, id, section, start_line, end_line, text, neighbors."""
    rows = spread(docs).select(F.col(file_col).alias("file"), T.stem(F.coalesce(file_col, F.lit(""))).alias("stem"), F.col(text_col).alias("text")).mapInArrow(_chunks, _RAW)
    link = lambda c, way: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).alias("id"), F.lit(way).alias("direction")))).otherwise(F.array().cast(_LINK))
    return rows.withColumn("neighbors", F.concat(link("before", "previous"), link("after", "next"))).drop("before", "after")


def normalise(chunks: DataFrame, clock: int = 0, drop_empty: bool = True) -> DataFrame:
    """The txt chunk records; ``clock`` is the time of ingestion in seconds."""
    chunks = chunks.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).withColumn("_first", T.first_line("text"))
    chunks = chunks.withColumn("_name", F.lower(F.regexp_extract("_first", T.SECTION, 1)))  # once, for the type and the path
    text, name = F.col("text"), F.col("_name")
    path = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.nullif(T.section_hint(text, name), F.lit("")), F.substring("_first", 1, 120))
    out = chunks.select(
        T.stable_chunk_id("id", T.paper_id("id", "file"), "idx").alias("chunk_id"), T.paper_id("id", "file").alias("paper_id"), F.coalesce("file", F.lit("")).alias("source_file"),
        path.alias("section_path"), F.coalesce(F.nullif(F.col("section"), F.lit("")), path).alias("section"), "start_line", "end_line", T.chunk_type(text, name).alias("chunk_type"),
        text.alias("text"), F.length(text).alias("text_len"), T.token_estimate(text).alias("token_estimate"), T.math_loss(text).alias("has_math_loss"),
        F.array().cast("array<string>").alias("labels"), "neighbors", F.map_concat(F.create_map(F.lit("source"), F.lit("plain_text")), F.create_map(F.lit("source_kind"), F.lit("plain_text"))).alias("meta"),
        T.harvest(text).alias("harvest"), F.lit(clock).cast("bigint").alias("added_at"), F.lit(VERSION).alias("version"),
    )
    return out.filter("text <> ''") if drop_empty else out
