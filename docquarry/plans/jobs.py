"""Whole jobs: ingestion, chunking, indexing, search, question answering, evaluation."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk_md, chunk_txt, evaluate, index, latex, plugins, rag, search
from ..sources import archives, catalogue, jsonl, sinks
from .settings import SearchSettings, defaults


def prepare_corpus(raw: DataFrame) -> DataFrame:
    """(paper, text): archives (paper, content) expanded, main files with their includes, cleaned."""
    return latex.combine(archives.expand(raw).filter(F.lower("path").endswith(".tex")))


def run_etl(spark: SparkSession, phrases, categories, path: str, fetch: str, archive: str, citations: str | None = None, cache: DataFrame | None = None, max_results: int = 300, delay: float = 3.0) -> dict[str, DataFrame]:
    """From a catalogue query to clean text: papers, sources, one text each, and a report, all written under ``path``.

    fetch, archive, citations: clients as "module:function" (see catalogue). texts/ has one file a paper, by its
    base id; archives/ is the cache of a next run.
    """
    found = catalogue.latest_versions(catalogue.papers(catalogue.scan(spark, catalogue.search_query(phrases, categories), fetch, max_results)))
    if citations:
        cited = catalogue.fetch_citations(found, citations, delay=delay).withColumn("reference_list", F.array().cast("array<string>"))
        found = catalogue.enrich(found, cited)
    found.write.mode("overwrite").parquet(f"{path}/papers")
    papers = spark.read.parquet(f"{path}/papers")
    catalogue.fetch_archives(papers, cache, archive, delay=delay).write.mode("overwrite").parquet(f"{path}/archives")
    archives_ = spark.read.parquet(f"{path}/archives")
    texts = prepare_corpus(archives_.select(F.col("base_id").alias("paper"), "content"))
    sinks.write_texts(texts, f"{path}/texts", "paper", "text")
    out = {"papers": papers, "archives": archives_, "texts": sinks.read_texts(spark, f"{path}/texts")}
    have = out["texts"].select(F.col("name").alias("base_id"), F.lit(True).alias("has_text"))
    out["report"] = catalogue.widen(papers.select("base_id", "title"), archives_.select("base_id", F.lit(True).alias("has_source")), have).select(
        "base_id", F.trim("title").alias("title"), F.coalesce("has_source", F.lit(False)).alias("has_source"), F.coalesce("has_text", F.lit(False)).alias("has_text"))
    jsonl.write(out["report"], f"{path}/report")
    return out


def chunk_markdown(docs: DataFrame, clock: int = 0) -> DataFrame:
    return chunk_md.normalise(chunk_md.link(chunk_md.chunk(docs)), clock)


def chunk_text(docs: DataFrame, clock: int = 0) -> DataFrame:
    return chunk_txt.normalise(chunk_txt.chunk(docs), clock)


def run_chunking(md: DataFrame, txt: DataFrame, path: str, clock: int = 0) -> dict[str, DataFrame]:
    """Writes both branches as JSON lines; documents without text are in ``quarantine``, not an error."""
    out = {}
    for name, docs, f in (("md", md, chunk_markdown), ("txt", txt, chunk_text)):
        jsonl.write(f(docs.filter("text IS NOT NULL"), clock), f"{path}/{name}")
        out[name] = docs.sparkSession.read.json(f"{path}/{name}")
        out[f"{name}_quarantine"] = docs.filter("text IS NULL").select("file")
    return out


def run_indexing(chunks: DataFrame, path: str, source: str, embed=None, dim: int | None = None) -> dict[str, DataFrame]:
    d = defaults(source)
    dim = dim or d["dim"]
    spec = index.MD_SPEC if source == "md" else index.TXT_SPEC
    vectors = index.VectorSpec(d["collection"], dim, embed or plugins.hashing_embedder(dim), payload=tuple(c for c in search.PAYLOAD if c in chunks.columns))
    return {"bm25": index.build_lexical(chunks, f"{path}/lexical", spec), "vectors": index.build_vectors(chunks, path, vectors)}


class SearchService:
    """An opened index; one for each settings, at most four are kept."""

    def __init__(self, spark: SparkSession, settings: SearchSettings, embed=None):
        self.settings, self.embed = settings, embed or plugins.hashing_embedder(defaults(settings.source)["dim"])
        self.lexical = index.open_lexical(spark, f"{settings.index_path}/lexical")
        self.vectors = index.open_points(spark, f"{settings.index_path}/{settings.collection}")
        found = index.collection_dim(self.vectors)
        index.check_dims(settings.collection, found, found, settings.expected_dim)

    def search(self, queries: DataFrame, with_payloads: bool = True) -> DataFrame:
        s = self.settings
        lists = self.ranked(queries)
        return search.hybrid(*lists, self.vectors.drop("vec") if with_payloads else None, s.topk)

    def ranked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        s = self.settings
        bm25 = search.top(search.bm25_scores(queries, self.lexical["postings"], self.lexical["stats"]), s.bm25, F.desc("score"), F.asc("chunk_id"))
        asked = queries.select("query_id", self.embed(F.col("query")).alias("query_vec"))
        return bm25, search.dense_search(asked, self.vectors, s.dense)


@lru_cache(maxsize=4)
def service(spark: SparkSession, settings: SearchSettings) -> SearchService:
    return SearchService(spark, settings)


def retrieve(queries: DataFrame, services: list[SearchService], k: int = search.TOPK) -> DataFrame:
    """md and txt results in one list, reranked."""
    md, txt = (s.search(queries) for s in services)
    items = search.union_sources(md, txt).join(queries.select("query_id", "query"), "query_id")
    return search.rerank(items, plugins.overlap_reranker("query", F.coalesce("text", F.lit(""))), k)


def answer(queries: DataFrame, services: list[SearchService], budget: int = rag.BUDGET, client=None) -> DataFrame:
    """(query_id, query, blocks, prompt, answer)."""
    packed = rag.pack_context(retrieve(queries, services), budget).join(queries, "query_id")
    asked = packed.withColumn("prompt", rag.prompt("query", rag.render_context("blocks")))
    return plugins.llm(asked, client) if client else plugins.extractive_llm(asked)


def evaluate_retrieval(gold: DataFrame, services: list[SearchService]) -> DataFrame:
    """gold: query_id, query, chunk_id. One row: queries, hit_rate, mrr."""
    return evaluate.retrieval_quality(evaluate.matches(gold, retrieve(gold.select("query_id", "query"), services)))


def query_prompts(chunks: DataFrame, keywords: list[str], n: int, seed: int = 0) -> DataFrame:
    """Prompts that ask for one question about a sampled chunk of the wanted sections."""
    path = F.col("section_path") if "section_path" in chunks.columns else F.lit("")
    some = evaluate.sample(chunks.filter(T.keyword_in_section("section", path, keywords)), n, "chunk_id", seed)
    ask = F.concat(F.lit("Write one conceptual question that a student of this text could answer without seeing it.\n\nTEXT:\n"), "text")
    return some.select("chunk_id", "text", F.struct(F.lit("You write questions about advanced texts.").alias("system"), ask.alias("user")).alias("prompt"))


def judge_prompts(answers: DataFrame) -> DataFrame:
    """answers: query, original, answer. With ``prompt``: the judge's five dimensions, their weights and the JSON wanted."""
    weights = ", ".join(f"{k} {w:.2f}" for k, w in evaluate.WEIGHTS.items())
    system = f"You compare an answer with a source text and return only JSON with the fields {evaluate.JUDGEMENT}. overall_score is the rounded weighted sum: {weights}."
    user = F.concat(F.lit("Query:\n"), "query", F.lit("\n\nOriginal Text:\n"), "original", F.lit("\n\nRAG Response:\n"), "answer")
    return answers.withColumn("prompt", F.struct(F.lit(system).alias("system"), user.alias("user")))


def evaluate_answers(judged: DataFrame, json_col: str = "judgement") -> DataFrame:
    return evaluate.judge_means(judged.select(evaluate.parse_json(json_col, evaluate.JUDGEMENT).alias("j")).select("j.*"))
