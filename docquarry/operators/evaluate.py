"""Retrieval and answer quality: matches, hit rate, reciprocal rank, judged scores, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("overall_score", "correctness", "coverage", "enrichment", "specificity", "relevance")
JUDGEMENT = (
    "overall_score double, correctness double, coverage double, enrichment double, specificity double, relevance double, band string, "
    "original_key_points array<string>, improvements_added_by_rag array<string>, issues_found array<string>, "
    "contradictions array<struct<claim_in_rag:string,conflicts_with_original:string,why_it_matters:string>>, verdict string"
)
EVAL_QUERY = "query string, complexity int, status string, reason string"
WEIGHTS = {"correctness": 0.30, "coverage": 0.25, "enrichment": 0.25, "specificity": 0.10, "relevance": 0.10}
BANDS = ((90, "excellent"), (75, "good"), (60, "fair"), (40, "poor"), (None, "very_poor"))


def matches(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, rank, is_match): each query has a row at least."""
    got = gold.select("query_id", F.col("chunk_id").alias("gold_id")).join(retrieved.select("query_id", "rank", "chunk_id"), "query_id", "left")
    return got.select("query_id", "rank", F.coalesce(F.col("chunk_id") == F.col("gold_id"), F.lit(False)).alias("is_match"))


def retrieval_quality(found: DataFrame) -> DataFrame:
    """One row: queries, hit_rate, mrr; null rates without queries."""
    per = found.groupBy("query_id").agg(F.max(F.col("is_match").cast("int")).alias("hit"), F.coalesce(1.0 / F.min(F.when(F.col("is_match"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"))


def match_lists(found: DataFrame) -> DataFrame:
    """(query_id, matches): array<boolean> in rank order."""
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "is_match"))), lambda x: x["is_match"]).alias("matches"))


def judge_means(judged: DataFrame, metrics=METRICS) -> DataFrame:
    return judged.agg(*[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics])


def parse_json(text: Column | str, schema: str) -> Column:
    return F.from_json(text, T.StructType.fromDDL(schema), {"mode": "PERMISSIVE"})


def overall(c: dict[str, str] | None = None) -> Column:
    """The weighted score of the five dimensions."""
    return F.round(sum(F.col((c or {}).get(k, k)) * w for k, w in WEIGHTS.items()))


def band(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    out = None
    for least, name in BANDS:
        out = F.when(s >= least, name) if out is None else out.otherwise(name) if least is None else out.when(s >= least, name)
    return out


def keep_queries(evaluated: DataFrame) -> DataFrame:
    """Non-blank queries that the judge didn't fail; the repaired query, where there is none the first."""
    kept = evaluated.filter((F.trim(F.coalesce("query_v1", F.lit(""))) != "") & (F.coalesce("evaluation", F.lit("OK")) != "fail"))
    return kept.withColumn("query_v2", F.coalesce("query_v2", "query_v1"))


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, all if there are fewer: by the order of a seeded hash, so that it can be repeated."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def tagged_samples(md: DataFrame, txt: DataFrame, n: int, key: str = "chunk_id", seed: int = 0) -> DataFrame:
    return sample(md, n, key, seed).withColumn("etl", F.lit("md")).unionByName(sample(txt, n, key, seed).withColumn("etl", F.lit("txt")), allowMissingColumns=True)
