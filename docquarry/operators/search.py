"""Ranked retrieval for a table of queries: BM25, dense, reciprocal rank fusion, hybrid search with late payloads.

Scores are rounded before ranking, so that an order of addition never decides a rank; ties go to the smaller id.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from ..functions import text as T
from ..sources.layout import spread
from .index import document_frequency, field_stats, positions, postings

K1, B, RRF_K, CANDIDATES, TOPK = 1.2, 0.75, 60, 200, 10
#: Terms that are broadcast, bytes of queries that go to the workers at once, and terms x queries that do.
ASKED, QUERY_BYTES, WEIGHTS = 200_000, 64 << 20, 1 << 25
PAYLOAD = ("paper_id", "section", "source_file", "start_line", "end_line", "labels", "equations_raw", "text")


def top(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The k first of each query, with their rank from 1; Spark keeps k rows of each query in each task."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def bm25_scores(queries: DataFrame, post: DataFrame, stats: DataFrame, df: DataFrame | None = None, mode: str = "or") -> DataFrame:
    """(query_id, chunk_id, score): Robertson's weights, summed over fields and distinct terms; mode ``and`` needs every term."""
    return _scores(queries, post.join(_asked(queries), "term", "left_semi"), stats, df, mode)


def _scores(queries: DataFrame, held: DataFrame, stats: DataFrame, df: DataFrame | None = None, mode: str = "or") -> DataFrame:
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens("query"))).alias("term"))
    held = held if "df" in held.columns else held.join(document_frequency(held) if df is None else df, ["field", "term"])
    met = asked.join(held, "term").join(F.broadcast(stats), "field")  # one row a field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    score = F.round(F.sum(weight), 6).alias("score")
    out = met.groupBy("query_id", "chunk_id").agg(score, *([F.count_distinct("term").alias("terms")] if mode == "and" else []))
    if mode == "and":
        out = out.join(asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked")), "query_id").filter("terms = asked")
    return out.select("query_id", "chunk_id", "score")


def _asked(queries: DataFrame) -> DataFrame:
    """The queries' terms; up to ``ASKED`` of them are broadcast, so that other terms stay where they are."""
    terms = queries.select(F.explode(F.array_distinct(T.tokens("query"))).alias("term")).distinct()
    return F.broadcast(terms) if terms.limit(ASKED + 1).count() <= ASKED else terms


def bm25_search(queries: DataFrame, docs: DataFrame, k: int = CANDIDATES, fields=("text",), key: str = "chunk_id", mode: str = "or") -> DataFrame:
    """Straight from documents (unique ids): nothing but the queries' terms is counted, and no index is shuffled.

    One scan counts in how many documents each asked term stands; a second weighs each document's terms and multiplies
    them with the queries, batch by batch, keeping the k best of every query in each task. Where terms x queries exceed
    ``WEIGHTS`` the postings of the asked terms are joined instead, with the same scores.
    """
    docs = spread(docs)
    asked = queries.select("query_id", F.array_distinct(T.tokens("query")).alias("t")).filter(F.size("t") > 0)
    terms, many = _asked(queries), asked.count()
    stats = field_stats(docs, fields)
    if terms.count() * many > WEIGHTS:
        return top(_scores(queries, postings(docs, key, fields, terms), stats, mode=mode), k, F.desc("score"), F.asc("chunk_id"))
    held = [docs.select(F.lit(f).alias("field"), F.explode(F.array_distinct(T.tokens(f))).alias("term")) for f in fields]
    df = reduce(DataFrame.unionByName, held).join(terms, "term", "left_semi").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    found = _weighed(asked.toArrow(), docs, key, fields, stats.collect(), df.toArrow(), k, mode)
    return top(found, k, F.desc("score"), F.asc("chunk_id"))


def _weighed(asked: pa.Table, docs: DataFrame, key: str, fields, stats: list, df: pa.Table, k: int, mode: str) -> DataFrame:
    """(query_id, chunk_id, score): the k best of each query in each task."""
    terms = sorted({t for ts in asked["t"].to_pylist() for t in ts})
    number = {t: n for n, t in enumerate(terms)}
    wanted = np.zeros((len(terms), asked.num_rows))
    for j, ts in enumerate(asked["t"].to_pylist()):
        wanted[[number[t] for t in ts], j] = 1
    average = {r["field"]: (r["n_docs"], r["avg_len"]) for r in stats}
    idf = {f: np.zeros(len(terms)) for f in fields}
    for f, t, n in zip(*(df[c].to_pylist() for c in ("field", "term", "df")), strict=True):
        idf[f][number[t]] = math.log(1 + (average[f][0] - n + 0.5) / (n + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast((asked["query_id"].to_pylist(), terms, wanted, idf))
    id_type, query_type = docs.schema[key].dataType, asked.schema.field("query_id").type

    def run(batches):
        names, terms, wanted, idf = shared.value
        values, best = pa.array(terms, pa.string()), Best(len(names), k)
        step = max(1, (1 << 22) // max(1, len(terms)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                score, some = np.zeros((b.num_rows, len(names))), np.zeros((b.num_rows, len(terms)))
                for f, column in zip(fields, b.columns[1:], strict=True):
                    size = column.value_lengths().to_numpy(zero_copy_only=False)
                    term = pc.fill_null(pc.index_in(column.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False)
                    doc = np.repeat(np.arange(b.num_rows), size)
                    tf = np.bincount(doc[term >= 0] * len(terms) + term[term >= 0], minlength=b.num_rows * len(terms)).reshape(b.num_rows, -1)
                    norm = K1 * (1 - B + B * size / (average[f][1] or 1))
                    score += (idf[f] * tf * (K1 + 1) / (tf + norm[:, None])) @ wanted
                    some += tf
                met = (some > 0) @ wanted
                hit = met == wanted.sum(axis=0) if mode == "and" else met > 0
                best.add(np.where(hit, np.round(score, 6), -np.inf), np.array(b.column(0).to_pylist()))
        yield from best.rows(names, query_type, to_arrow_type(id_type))

    schema = f"query_id {from_arrow_type(query_type).simpleString()}, chunk_id {id_type.simpleString()}, score double"
    return docs.select(F.col(key), *[T.tokens(f).alias(f"t{n}") for n, f in enumerate(fields)]).mapInArrow(run, schema)


def phrase_search(queries: DataFrame, docs: DataFrame, k: int = CANDIDATES, field: str = "text", key: str = "chunk_id") -> DataFrame:
    """Documents that hold all of a query's tokens next to each other and in order; (query_id, chunk_id, score, rank), score is how often.

    Positions come with the postings of the queries' terms: token n of the phrase at position p votes for the start p - n.
    """
    asked = queries.select("query_id", T.tokens("query").alias("t")).filter(F.size("t") > 0)
    words = asked.select("query_id", F.size("t").alias("words"), F.posexplode("t").alias("n", "term"))
    held = positions(docs, key, field).join(words.select("term").distinct(), "term", "left_semi")
    starts = held.join(words, "term").groupBy("query_id", "chunk_id", (F.col("pos") - F.col("n")).alias("start"), "words").agg(F.count(F.lit(1)).alias("met"))
    found = starts.filter("met = words").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return top(found, k, F.desc("score"), F.asc("chunk_id"))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, key: str = "chunk_id", vec: str = "vec") -> DataFrame:
    """Exact cosine of each stated query (query_id, query_vec) with every vector: (query_id, chunk_id, score, rank).

    The queries are few: blocks of at most ``QUERY_BYTES`` go to the workers, which multiply them with each batch of vectors and
    keep the k best of every query. Vectors are never shuffled; a task returns at most queries x k rows.
    """
    unit = queries.filter("query_vec IS NOT NULL").select("query_id", T.normalised("query_vec").alias("u"))
    size = unit.agg(F.sum(F.size("u") * 8)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for b in range(blocks):
        got = _dense(unit.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), vectors, k, key, vec)
        out = got if out is None else out.unionByName(got)
    return top(out, k, F.desc("score"), F.asc("chunk_id"))


class Best:
    """The k best ids of each query: greater scores first, then smaller ids; a score of -inf is none."""

    def __init__(self, queries: int, k: int):
        self.n, self.k, self.held = queries, k, None
        self.least = np.full(queries, -np.inf)

    def add(self, score: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """score: ids x the queries from ``first`` on."""
        least = self.least[first : first + score.shape[1]]
        i, j = np.nonzero((score >= least) & (score > -np.inf))
        new = (j + first, score[i, j], ids[i])
        held = new if self.held is None else tuple(np.concatenate(p) for p in zip(self.held, new, strict=True))
        order = np.lexsort((held[2], -held[1], held[0]))
        begin = np.flatnonzero(np.diff(held[0][order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        order = order[nth < self.k]
        self.held = tuple(p[order] for p in held)
        n = np.bincount(self.held[0], minlength=self.n)
        last = np.maximum(np.cumsum(n) - 1, 0)
        self.least = np.where(n >= self.k, self.held[1][last], -np.inf) if len(order) else self.least

    def rows(self, names: list, query_type: pa.DataType, id_type: pa.DataType):
        if self.held is not None:
            query, score, ids = self.held
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in query], query_type), pa.array(ids.tolist(), id_type), pa.array(score)], names=["query_id", "chunk_id", "score"])


def _dense(unit: DataFrame, vectors: DataFrame, k: int, key: str, vec: str) -> DataFrame:
    asked = unit.toArrow()  # at most QUERY_BYTES
    shared = unit.sparkSession.sparkContext.broadcast((asked["query_id"].to_pylist(), asked["u"].to_pylist()))
    id_type, query_type = (vectors.schema[key].dataType, unit.schema["query_id"].dataType)

    def run(batches):
        names, rows = shared.value
        q, best = np.array(rows, float).reshape(len(rows), -1), Best(len(names), k)
        for b in batches:
            if b.num_rows and names:
                x = np.array(b.column(1).to_pylist(), float)
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, norm, out=x, where=norm > 0)
                ids = np.array(b.column(0).to_pylist())
                for at in range(0, len(names), 256):
                    best.add(np.round(x @ q[at : at + 256].T, 6) + 0.0, ids, at)
        yield from best.rows(names, to_arrow_type(query_type), to_arrow_type(id_type))

    schema = f"query_id {query_type.simpleString()}, chunk_id {id_type.simpleString()}, score double"
    return vectors.filter(F.col(vec).isNotNull()).select(F.col(key), F.col(vec)).mapInArrow(run, schema)


def rrf_fuse(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, fused, rank, r0, r1, ..., s0, s1, ...): sum of 1 / (k + rank); ties keep the lists' order; s: the lists' scores."""
    every = None
    for n, r in enumerate(ranked):
        own = r.select("query_id", "chunk_id", F.lit(n).alias("list"), "rank", F.col("score") if "score" in r.columns else F.lit(None).cast("double").alias("score"))
        every = own if every is None else every.unionByName(own)
    mine = lambda n, c: F.min(F.when(F.col("list") == n, F.col(c)))
    firsts = [mine(n, c).alias(f"{c[0]}{n}") for c in ("rank", "score") for n in range(len(ranked))]
    fused = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("fused"), *firsts)
    order = [F.desc("fused"), *[F.col(f"r{n}").asc_nulls_last() for n in range(len(ranked))]]
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def fetch_payloads(top_ids: DataFrame, payloads: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One left join instead of a look-up for each id; of payloads with one id the first counts."""
    one = payloads.withColumnRenamed(key, "chunk_id") if key != "chunk_id" else payloads
    return top_ids.join(one.join(top_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]), "chunk_id", "left")


def hybrid(bm25: DataFrame, dense: DataFrame, payloads: DataFrame | None = None, k: int = TOPK, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, rank, chunk_id, fused_score, bm25_score, dense_score, payload...): scores missing from a list are 0."""
    best = rrf_fuse(bm25, dense, k=rrf_k).filter(F.col("rank") <= k)
    out = best.select("query_id", "chunk_id", F.col("fused").alias("fused_score"), "rank", F.coalesce("s0", F.lit(0.0)).alias("bm25_score"), F.coalesce("s1", F.lit(0.0)).alias("dense_score"))
    if payloads is None:
        return out
    keep = ["chunk_id", *[c for c in PAYLOAD if c in payloads.columns]]
    found = fetch_payloads(out, payloads.select(*keep))
    return found.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))) if "text" in keep else found


def diagnostics(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """(query_id, bm25_hits, dense_hits)."""
    a, b = (r.groupBy("query_id").agg(F.count(F.lit(1)).alias(n)) for r, n in ((bm25, "bm25_hits"), (dense, "dense_hits")))
    return a.join(b, "query_id", "full").select("query_id", F.coalesce("bm25_hits", F.lit(0)).alias("bm25_hits"), F.coalesce("dense_hits", F.lit(0)).alias("dense_hits"))


def union_sources(md: DataFrame, txt: DataFrame) -> DataFrame:
    """md results, then txt results, with their position in the joined list."""
    both = md.withColumn("etl", F.lit("md")).unionByName(txt.withColumn("etl", F.lit("txt")), allowMissingColumns=True)
    return both.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("etl", "rank")))


def rerank(items: DataFrame, score: Column, k: int = TOPK, position: str = "position") -> DataFrame:
    """Best scores first, ties in the order of the input."""
    return top(items.withColumn("rerank_score", score).drop("rank"), k, F.desc("rerank_score"), F.col(position).asc())
