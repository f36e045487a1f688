"""Context packing, rendering and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BUDGET = 1800

# The prompt's texts.
SYSTEM = (
    "You are a careful technical assistant. Use ONLY the provided context to answer. "
    "If the context is insufficient, say so clearly. Always cite sources as [chunk_id]."
)
SYSTEM_MATH = " Preserve LaTeX exactly; do not alter math notation."
INSTRUCTIONS = (
    "- Answer concisely and accurately using the CONTEXT only.",
    "- Include inline citations to the most relevant chunk_ids like [paper123_s3_p2_c5].",
    "- If multiple steps or lemmas are used, cite each where used.",
    "- If the answer is uncertain with given CONTEXT, state what is missing.",
)


def pack_context(results: DataFrame, budget: int = BUDGET, by: str = "query_id", order: str = "rank") -> DataFrame:
    """(query_id, blocks): in rank order, a text that doesn't fit is skipped and the next is tried. Results are a top-k."""
    have = results.columns
    block = F.struct(
        F.col(order).alias("rank"), F.col("chunk_id"), (F.col("paper_id") if "paper_id" in have else F.lit(None).cast("string")).alias("paper_id"),
        (F.col("section") if "section" in have else F.lit(None).cast("string")).alias("section"), F.coalesce("text", F.lit("")).alias("text"),
        (F.coalesce("equations_raw", F.array().cast("array<string>")) if "equations_raw" in have else F.array().cast("array<string>")).alias("equations_raw"),
        T.context_estimate("text").alias("est"),
    )
    lists = results.groupBy(by).agg(F.array_sort(F.collect_list(block)).alias("items"))

    def step(s, x):
        fits = s["used"] + x["est"] <= budget
        return F.struct(F.when(fits, s["used"] + x["est"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["kept"], F.array(x["rank"]))).otherwise(s["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    kept = F.aggregate("items", start, step, lambda s: s["kept"])
    return lists.select(by, F.filter("items", lambda x: F.array_contains(kept, x["rank"])).alias("blocks"))


def render_context(blocks: Column | str) -> Column:
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("["), none(b["chunk_id"]), F.lit("] "), none(b["paper_id"]), F.lit(" — "), none(b["section"]), F.lit("\n"), b["text"], F.lit("\n"))), "\n---\n")


def prompt(question: Column | str, context: Column | str) -> Column:
    """struct(system, user); mathematical questions get one more sentence."""
    q, c = (F.col(x) if isinstance(x, str) else x for x in (question, context))
    system = F.when(T.is_mathy(q), SYSTEM + SYSTEM_MATH).otherwise(SYSTEM)
    gap = "\n    "
    user = F.concat(F.lit("QUESTION:" + gap), q, F.lit("\n\n    CONTEXT:" + gap), c, F.lit("\n\n    INSTRUCTIONS:" + gap + gap.join(INSTRUCTIONS)))
    return F.struct(system.alias("system"), T.strip(user).alias("user"))
