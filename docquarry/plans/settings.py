"""Settings with typed defaults, resolved on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Defaults of the two branches.
DEFAULTS = {
    "md": {"collection": "md_chunks", "model": "BAAI/bge-small-en", "dim": 384, "batch": 64, "bm25": 200, "dense": 200, "topk": 10},
    "txt": {"collection": "txt_chunks", "model": "BAAI/bge-base-en-v1.5", "dim": 768, "batch": 64, "bm25": 200, "dense": 200, "topk": 10},
}
_NAMES = {"collection": "QDRANT_COLLECTION", "model": "EMBEDDING_MODEL", "dim": "EMBEDDING_DIM", "batch": "QDRANT_BATCH_SIZE", "bm25": "BM25_CANDIDATES", "dense": "DENSE_CANDIDATES", "topk": "TOPK"}


def defaults(source: str) -> dict:
    """The branch's defaults, environment variables (MD_TOPK, ...) over them."""
    if source not in DEFAULTS:
        raise ValueError(f"unknown source {source!r}: md or txt")
    return {k: type(v)(os.environ.get(f"{source.upper()}_{_NAMES[k]}", v)) for k, v in DEFAULTS[source].items()}


@dataclass(frozen=True)
class SearchSettings:
    source: str
    index_path: str
    collection: str
    model: str
    bm25: int
    dense: int
    topk: int
    expected_dim: int | None

    @classmethod
    def of(cls, source: str, index_path: str, collection=None, model=None, bm25=None, dense=None, topk=None, expected_dim=None) -> SearchSettings:
        """Arguments that are 0, empty or None give way to defaults; an expected dimension of 0 stays."""
        d = defaults(source)
        return cls(source, index_path, collection or d["collection"], model or d["model"], bm25 or d["bm25"], dense or d["dense"], topk or d["topk"], d["dim"] if expected_dim is None else expected_dim)
