"""Paper metadata: query strings, paged catalogue scan, projection, deduplication, citations, availability."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

PAPER = (
    "arxiv_id string, base_id string, sanitized_id string, version string, title string, primary_category string, categories array<string>, "
    "authors array<string>, published_date string, updated_date string, url string, summary string, comment string, citation_list array<string>, reference_list array<string>"
)
ENTRY = (
    "entry_id string, title string, primary_category string, categories array<string>, authors array<struct<name:string>>, published string, "
    "updated string, summary string, comment string"
)
BATCH = 50


def search_query(phrases: Iterable[str], categories: Iterable[str]) -> str:
    phrase = " OR ".join(f'all:"{p}"' for p in phrases)
    return f"({phrase}) AND ({' OR '.join(f'cat:{c}' for c in categories)})"


def matches(phrases: list[str], categories: list[str], text_col: str = "text", categories_col: str = "categories"):
    """The same query as a predicate over rows."""
    low = F.lower(F.col(text_col))
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p)) & F.arrays_overlap(categories_col, F.array(*[F.lit(c) for c in categories]))


class _Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class CatalogueSource(DataSource):
    """``spark.read.format("paper_catalogue")``: one partition a page of ``BATCH`` results, at most ``max_results`` rows.

    ``fetch`` (options: "module:function") gets (query, offset, limit) and returns entries; a page that fails is tried three
    times, with a growing pause (option ``delay``, seconds), and then is empty.
    """

    @classmethod
    def name(cls):
        return "paper_catalogue"

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.query, self.most, self.fetch = options["query"], int(options.get("max_results", "300")), options["fetch"]
        self.delay = float(options.get("delay", "3"))

    def partitions(self):
        return [_Page(o, min(BATCH, self.most - o)) for o in range(0, max(self.most, 0), BATCH)] or [_Page(0, 0)]

    def read(self, page):
        if page.limit:
            got = _tried(lambda: _client(self.fetch)(self.query, page.offset, page.limit), 3, self.delay)
            yield from (tuple(r) for r in (got or [])[: page.limit])


def _client(name: str) -> Callable:
    import importlib

    module, _, f = name.partition(":")
    return getattr(importlib.import_module(module), f)


def _tried(call: Callable, times: int, delay: float):
    """What ``call`` returns; None after ``times`` failures, with a growing pause between them."""
    import time

    for k in range(times):
        try:
            return call()
        except Exception:  # noqa: BLE001 - a client may fail in any way; one paper's failure stops no job
            if k + 1 < times:
                time.sleep(delay * 2**k)
    return None


def fetch_citations(papers_: DataFrame, client: str, times: int = 3, delay: float = 1.0) -> DataFrame:
    """(arxiv_id, citation_list): ids of the citing papers by ``client`` ("module:function" of a base id), nulls left out."""

    def run(batches):
        call = _client(client)
        for b in batches:
            got = [_tried(lambda i=i: call(i), times, delay) or [] for i in b.column(1).to_pylist()]
            ids = [[x for r in rs if (x := ((r.get("citedPaper") or r.get("citingPaper") or {}).get("externalIds") or {}).get("ArXiv"))] for rs in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.string()))], names=["arxiv_id", "citation_list"])

    return papers_.select("arxiv_id", "base_id").mapInArrow(run, "arxiv_id string, citation_list array<string>")


def fetch_archives(papers_: DataFrame, cache: DataFrame | None, client: str, times: int = 3, delay: float = 3.0) -> DataFrame:
    """(base_id, content): sources that the cache (same columns) has, and those that ``client`` ("module:function" of a name) gives.

    A paper's candidate names are tried in turn; one that no name gives is left out.
    """
    todo = to_fetch(papers_, cache) if cache is not None else to_fetch(papers_, papers_.select("base_id", F.lit(None).cast("binary").alias("content")))
    names = todo.groupBy("base_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "candidate"))), lambda c: c["candidate"]).alias("names"))

    def run(batches):
        call = _client(client)
        for b in batches:
            content = [next((c for n in names if (c := _tried(lambda n=n: call(n), times, delay))), None) for names in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], names=["base_id", "content"])

    new = names.mapInArrow(run, "base_id string, content binary").filter("content IS NOT NULL")
    return new if cache is None else cache.filter("octet_length(content) > 0").select("base_id", "content").unionByName(new)


def scan(spark: SparkSession, query: str, fetch: str, max_results: int = 300) -> DataFrame:
    spark.dataSource.register(CatalogueSource)
    return spark.read.format("paper_catalogue").option("query", query).option("fetch", fetch).option("max_results", max_results).load()


def pages_of(total: int, size: int = BATCH) -> int:
    return math.ceil(total / size)


def papers(entries: DataFrame) -> DataFrame:
    """Entries as papers; of entries with one id the first (by ``seq`` if there is one) stays."""
    i = T.catalogue_id("entry_id")
    order = F.col("seq") if "seq" in entries.columns else F.col("entry_id")
    p = entries.select(
        F.concat(i["base_id"], i["version"]).alias("arxiv_id"), i["base_id"].alias("base_id"), i["sanitized_id"].alias("sanitized_id"), i["version"].alias("version"), T.strip("title").alias("title"),
        "primary_category", "categories", F.transform("authors", lambda a: a["name"]).alias("authors"), F.col("published").alias("published_date"),
        F.coalesce("updated", "published").alias("updated_date"), F.col("entry_id").alias("url"), "summary", "comment", order.alias("_seq"),
    )
    return p.withColumn("_n", F.row_number().over(W.partitionBy("arxiv_id").orderBy("_seq"))).filter("_n = 1").drop("_n", "_seq")


def latest_versions(papers_: DataFrame) -> DataFrame:
    """One paper a base id: the one that comes last overwrites the others."""
    v = F.regexp_extract("version", r"(\d+)", 1).cast("int")
    return papers_.withColumn("_n", F.row_number().over(W.partitionBy("base_id").orderBy(v.desc_nulls_last()))).filter("_n = 1").drop("_n")


def neighbour_ids(records: str):
    """Ids of citing or cited papers; null where a record has none."""
    return F.transform(records, lambda r: F.coalesce(r["citedPaper"], r["citingPaper"])["externalIds"]["ArXiv"])


def enrich(papers_: DataFrame, citations: DataFrame) -> DataFrame:
    """With citation_list and reference_list by arxiv_id; empty where nothing is known."""
    none = F.array().cast("array<string>")
    out = papers_.drop("citation_list", "reference_list").join(citations.select("arxiv_id", "citation_list", "reference_list"), "arxiv_id", "left")
    return out.withColumn("citation_list", F.coalesce("citation_list", none)).withColumn("reference_list", F.coalesce("reference_list", none))


def available(papers_: DataFrame, archives: DataFrame) -> DataFrame:
    """Papers whose source is there (archives: base_id, content not empty)."""
    return papers_.join(archives.filter("content IS NOT NULL AND octet_length(content) > 0").select("base_id").distinct(), "base_id", "left_semi")


def to_fetch(papers_: DataFrame, archives: DataFrame) -> DataFrame:
    """(base_id, candidate, priority): what is still to be fetched, the names to try in turn."""
    todo = papers_.join(archives.filter("octet_length(content) > 0").select("base_id").distinct(), "base_id", "left_anti")
    old = F.contains("base_id", F.lit("/"))
    names = F.when(old, F.array(F.concat("base_id", "version"), F.col("base_id"))).otherwise(F.array(F.concat("base_id", "version")))
    return todo.select("base_id", F.posexplode(names).alias("priority", "candidate"))


def widen(papers_: DataFrame, *stages: DataFrame) -> DataFrame:
    """Left joins of per-stage results (base_id, ...): a paper that a stage doesn't know keeps nulls."""
    for s in stages:
        papers_ = papers_.join(s, "base_id", "left")
    return papers_
