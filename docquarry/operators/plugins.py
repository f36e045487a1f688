"""Models behind interfaces. The stand-ins need no network and always give the same answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def hashing_embedder(dim: int = 384) -> Callable[[Column], Column]:
    """Signed feature hashing: Catalyst hashes a text's tokens to signed slots, one Arrow batch of which is added up at a time."""

    @F.pandas_udf("array<double>")
    def added(slots: pd.Series) -> pd.Series:
        return slots.map(lambda s: np.bincount(np.abs(s) - 1, np.sign(s), dim) if len(s) else np.zeros(dim))

    def embed(x: Column) -> Column:
        sign = lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1).otherwise(-1)
        return added(F.transform(T.tokens(x), lambda w: (F.pmod(F.xxhash64(w), F.lit(dim)) + 1) * sign(w)))

    return embed


@lru_cache(maxsize=4)
def _model(load: Callable):
    return load()


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """An embedder for a real model: ``load`` runs once a worker, texts come in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _model(load)
        for s in batches:
            yield pd.Series(encode(s.fillna("").tolist()))

    return embed


def overlap_reranker(query: Column | str, text: Column | str) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q, t = F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def extractive_llm(prompts: DataFrame, context: str = "blocks") -> DataFrame:
    """``prompts`` with ``answer``: the first block's text with its citation, or that the context is insufficient."""
    first = F.get(context, F.lit(0))
    said = F.concat(F.lit("["), first["chunk_id"].cast("string"), F.lit("] "), F.substring(first["text"], 1, 400))
    return prompts.withColumn("answer", F.coalesce(said, F.lit("The context is insufficient.")))


def llm(prompts: DataFrame, call: Callable[[list[dict]], list[str]], prompt_col: str = "prompt") -> DataFrame:
    """``prompts`` with ``answer`` of a client that gets a batch of {system, user} at once."""

    @F.pandas_udf("string")
    def ask(p: pd.DataFrame) -> pd.Series:
        return pd.Series(call(p.to_dict("records")))

    return prompts.withColumn("answer", ask(prompt_col))
