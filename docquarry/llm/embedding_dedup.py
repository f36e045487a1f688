"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, connected components.

1. Equal vectors are one class from the start, with a number of its own, so copies never meet each other.
2. The number of hyperplanes follows the number of classes (about ``BLOCK`` classes a bucket), the number of tables follows
   from it: a pair at the threshold shares no table with probability ``MISS``. Vectors and planes are hashed as whole
   numbers, so a sign never depends on the order of an addition.
3. A bucket is cut into blocks of about ``BLOCK`` classes that carry their vectors, and block meets block inside a worker:
   no pair becomes a row. A pair counts in the first table that it shares. Its cosine is computed in double precision from
   the vectors themselves. A meeting returns each member's number of links and a forest of links: rows grow with the
   members, while all links count.
4. Components by large-star / small-star.

Nulls: vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing and are kept. A null
id links with nothing, its component is null and it is kept. Rows that repeat a vector count as other vectors, also under one
id; so do rows of one id with different vectors, each with its own links. Vectors of different lengths never link. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, meetings, result, scratch, stage, table

COSINE, MISS, SEED, BLOCK, BATCH_BLOCKS = 0.95, 1e-6, 7, 512, 16


def tables_for(classes: int, cosine: float, miss: float = MISS, block: int = BLOCK) -> tuple[int, int]:
    """(hyperplanes a table, tables) for this many vectors."""
    bits = min(62, max(2, math.ceil(math.log2(max(2, classes / block)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the components as bytes, null where the vector can't link."""
    kind = "<f4" if "float" in df.schema[vec_col].dataType.simpleString() else "<f8"

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                x = v.as_py()
                if not x or any(c is None for c in x):
                    out.append(None)
                    continue
                x = np.array(x, kind)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>")).mapInArrow(run, "vec_id long, v binary"), kind


class _Hyperplanes:
    """The codes of vectors in every table. Whole numbers below 2^53 add up exactly in any order."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.planes: dict[int, np.ndarray] = {}

    def codes(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n not in self.planes:
            self.planes[n] = np.rint(np.random.default_rng([self.seed, n]).standard_normal((n, self.bits * self.tables)) * 256)
        whole = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * (1 << 20))
        return (whole @ self.planes[n] > 0).reshape(len(x), self.tables, self.bits) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)


def _codes(classes: DataFrame, kind: str, bits: int, tables: int, seed: int) -> DataFrame:
    """(cls, t, size, code) for every table; size is the vector's length in bytes."""

    def run(batches):
        planes = _Hyperplanes(bits, tables, seed)
        for b in batches:
            cls, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            size = np.array([len(r) for r in raw])
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                code = planes.codes(_matrix([raw[k] for k in own], kind))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls[own], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(np.full(len(own) * tables, n, np.int32)), pa.array(code.ravel())], names=["cls", "t", "size", "code"])

    return classes.select("cls", "v").mapInArrow(run, "cls long, t int, size int, code long")


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with cosine(x[i], y[j]) >= ``cosine``; what lies next to the threshold is decided pair by pair."""
    p, q = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    i, j = np.nonzero(x @ y.T >= (cosine - 1e-9) * np.sqrt(p)[:, None] * np.sqrt(q))
    keep = np.einsum("ij,ij->i", x[i], y[j]) / np.sqrt(p[i] * q[j]) >= cosine
    return i[keep], j[keep]


def _met(blocks: DataFrame, kind: str, bits: int, tables: int, seed: int, cosine: float) -> DataFrame:
    """(a, b, n): b null, how many vectors link with a; or a link (a, b)."""

    def run(batches):
        planes = _Hyperplanes(bits, tables, seed)
        for batch in batches:
            for t, m, other in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                rows = m + (other or [])
                cls, times = (np.array([r[k] for r in rows], np.int64) for k in ("cls", "n"))
                x = _matrix([r["v"] for r in rows], kind)
                code = planes.codes(x)
                begin = len(m) if other else 0
                i, j = _linked(x[: len(m)], x[begin:], cosine)
                j = j + begin
                if not other:
                    i, j = i[i < j], j[i < j]
                new = ~(code[i, :t] == code[j, :t]).any(axis=1)  # no table before this one holds the pair
                i, j = i[new], j[new]
                if not len(i):
                    continue
                count = np.bincount(i, times[j], len(rows)) + np.bincount(j, times[i], len(rows))
                some = np.flatnonzero(count)
                parent, links = list(range(len(rows))), []

                def root(k, parent=parent):
                    while parent[k] != k:
                        parent[k] = k = parent[parent[k]]
                    return k

                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        parent[ra] = rb
                        links.append((a, b))
                a, b = np.array(links).T
                n = np.concatenate((count[some].astype(np.int64), np.zeros(len(a), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((cls[some], cls[a]))), pa.array([None] * len(some) + cls[b].tolist(), pa.int64()), pa.array(n)], names=["a", "b", "n"])

    return meetings(blocks, ["t", "size", "code"]).mapInArrow(run, "a long, b long, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, miss: float = MISS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    with scratch(df.sparkSession):
        return result(_near(df, id_col, vec_col, cosine, miss, seed, block), "near-vectors")


def _near(df: DataFrame, id_col: str, vec_col: str, cosine: float, miss: float, seed: int, block: int) -> DataFrame:
    vectors, kind = _vectors(df, id_col, vec_col)
    every = stage(vectors, "vec-all")
    classes = every.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "vec-classes")
    bits, tables = tables_for(classes.count(), cosine, miss, block)
    key = ["t", "size", "code"]
    codes = stage(_codes(classes, kind, bits, tables, seed), "vec-codes")
    full = codes.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(*key, F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    placed = codes.join(full, key).withColumn("block", F.pmod(F.xxhash64("cls", "t"), F.col("blocks")).cast("int"))
    dealt = placed.join(classes.select("cls", "n", "v"), "cls").groupBy(*key, "block", "blocks").agg(F.collect_list(F.struct("cls", "n", "v")).alias("m"))
    met = stage(_met(stage(dealt, "vec-blocks"), kind, bits, tables, seed, cosine), "vec-met", BATCH_BLOCKS)
    around = met.filter("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    components = connected_components(met.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cls")
    labels = classes.join(components, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    found = labels.join(least, "component").join(around, "cls", "left").select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    own = every.filter("v IS NOT NULL AND vec_id IS NOT NULL").join(found, "v").select("vec_id", "n_links", "component_id")
    lone = every.filter("v IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), reach AS (
  WITH RECURSIVE r(node, other) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.node, p.b FROM r JOIN pairs p ON p.a = r.other
  ) SELECT node, min(other) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n_links FROM pairs GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, reach.component_id, v.vec_id = reach.component_id AS kept
FROM v JOIN reach ON reach.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
