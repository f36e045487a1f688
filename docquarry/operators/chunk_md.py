"""Markdown chunking: fences, sections by heading, size-bounded packing with overlap, cross-reference graph.

Fences, sections and packing are one fold over a document's lines (see folds), in Arrow batches, without a shuffle. Only
the cross-reference graph joins, by (file, label).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.layout import spread
from . import folds

VERSION = "ppmdc-0.1"
_NONE = "array<struct<id:string,direction:string>>"


_SECTION = "array<struct<level:int,title:string,path:string,start:int,end:int>>"
_CHUNK = "array<struct<idx:int,section_path:string,level:int,title:string,start_line:int,end_line:int,text:string>>"


def _sections(texts: pd.Series) -> pd.Series:
    one = lambda level, title, path, paras: {"level": level, "title": title, "path": path, "start": paras[0][0], "end": paras[-1][1]}
    return texts.map(lambda t: [one(*s) for s in folds.markdown_sections(t or "")])


def _chunks(texts: pd.Series) -> pd.Series:
    names = ("idx", "section_path", "level", "title", "start_line", "end_line", "text")
    return texts.map(lambda t: [dict(zip(names, c, strict=True)) for c in folds.markdown_chunks(t or "")])


def sections(docs: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, sections): array(struct(level, title, path, start, end)); text before the first heading has level 0."""
    return docs.select(F.col(file_col).alias("file"), F.pandas_udf(_sections, _SECTION)(F.col(text_col)).alias("sections"))


def chunk(docs: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """Raw chunks in document order, one row each: file, pos, id, section_path, start_line, end_line, text, labels, refs, equations_raw, equation_count, meta."""
    d = spread(docs).select(F.col(file_col).alias("file"), F.pandas_udf(_chunks, _CHUNK)(F.col(text_col)).alias("chunks"))
    rows = d.select("file", F.posexplode("chunks").alias("pos", "c")).select("file", "pos", "c.*")
    ident = F.concat(T.stem("file"), F.lit("::L"), "start_line", F.lit("-"), "end_line", F.lit("::s"), "idx")
    eq = T.equations("text")
    return rows.select(
        "file", "pos", ident.alias("id"), "section_path", "start_line", "end_line", "text", T.labels("text").alias("labels"), T.refs("text").alias("refs"),
        eq.alias("equations_raw"), F.size(eq).alias("equation_count"), F.struct(F.struct("level", "title").alias("heading")).alias("meta"),
    )


def reference_edges(chunks: DataFrame) -> DataFrame:
    """(file, src, dst, label, ref_pos): a chunk refers to a label that another chunk of its file carries."""
    refs = chunks.select("file", F.col("pos").alias("src"), F.posexplode("refs").alias("ref_pos", "label"))
    held = chunks.select("file", F.col("pos").alias("dst"), F.explode("labels").alias("label"))
    return refs.join(held, ["file", "label"]).filter("src <> dst").select("file", "src", "dst", "label", "ref_pos")


def link(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``neighbors``: previous, next, then references and comments in order, each once."""
    ids = chunks.select("file", "pos", "id")
    step = lambda by, k, way: ids.select("file", F.col("pos").alias("own"), F.lit(way).alias("direction"), F.struct(F.lit(k).alias("k"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("key"), (F.col("pos") + by).alias("other"))
    edges = reference_edges(chunks)
    ref = lambda own, other, way, d: edges.select("file", F.col(own).alias("own"), F.lit(way).alias("direction"), F.struct(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("ref_pos").alias("b"), F.col("dst").alias("c"), F.lit(d).alias("d")).alias("key"), F.col(other).alias("other"))
    every = step(-1, 0, "previous").unionByName(step(1, 1, "next")).unionByName(ref("src", "dst", "reference", 0)).unionByName(ref("dst", "src", "comment", 1))
    named = every.join(ids.select("file", F.col("pos").alias("other"), "id"), ["file", "other"])
    first = named.groupBy("file", "own", "id", "direction").agg(F.min("key").alias("key"))
    nested = first.groupBy("file", F.col("own").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("key", "id", "direction"))).alias("n"))
    nested = nested.select("file", "pos", F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["direction"].alias("direction"))).alias("neighbors"))
    return chunks.join(nested, ["file", "pos"], "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast(_NONE)))


def normalise(chunks: DataFrame, clock: int = 0, drop_empty: bool = True) -> DataFrame:
    """The md chunk records; ``clock`` is the time of ingestion in seconds."""
    chunks = chunks.withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
    text, eq = F.col("text"), T.equations("text")
    out = chunks.select(
        T.stable_chunk_id("id", T.paper_id("id", "file"), "pos").alias("chunk_id"), T.paper_id("id", "file").alias("paper_id"), F.coalesce("file", F.lit("")).alias("source_file"),
        T.section_choice("meta.heading.title", "section_path").alias("section"), "labels", "refs", "neighbors", "start_line", "end_line", text.alias("text"), F.length(text).alias("text_len"),
        T.token_estimate(text).alias("token_estimate"), eq.alias("equations_raw"), F.size(eq).alias("equation_count"), F.lit(clock).cast("bigint").alias("added_at"), F.lit(VERSION).alias("version"),
    )
    return out.filter("text <> ''") if drop_empty else out


def report(chunks: DataFrame) -> DataFrame:
    """One row: distinct sorted paper ids, files, records."""
    return chunks.agg(F.array_sort(F.collect_set(F.nullif("paper_id", F.lit("")))).alias("paper_ids"), F.count_distinct("source_file").alias("files"), F.count(F.lit(1)).alias("records"))


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(file, text): headings and paragraphs of a page as Markdown, a blank line between blocks; scripts and styles go."""
    h = F.regexp_replace(F.col(html_col), r"(?is)<(script|style|nav|footer|head)\b.*?</\1>", "")
    for level in range(6, 0, -1):
        h = F.regexp_replace(h, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    h = F.regexp_replace(h, r"(?is)<(p|div|li|tr|article|section|br)\b[^>]*>", "\n\n")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", "")
    h = F.regexp_replace(F.replace(F.replace(F.replace(h, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")), r"\n{3,}", "\n\n")
    return pages.select(F.concat(F.lit("page"), F.col(id_col).cast("string"), F.lit(".md")).alias("file"), T.strip(h).alias("text"))
