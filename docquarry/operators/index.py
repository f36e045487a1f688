"""Inverted and vector indexes as tables: postings with lengths and statistics; points with payload."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.upsert import Store

FIELDS = ("text", "section")


@dataclass(frozen=True)
class LexicalSpec:
    """Which columns a document has in the index; ``keep`` admits documents, others count as filtered."""

    columns: dict[str, Callable[[], Column]]
    key: str = "chunk_id"
    fields: tuple[str, ...] = FIELDS
    keep: Callable[[], Column] = field(default=lambda: T.strip(F.coalesce("text", F.lit(""))) != "")
    mode: str = "overwrite"


@dataclass(frozen=True)
class VectorSpec:
    """Vectors of texts: which embedder, how payloads are built, how points are written."""

    collection: str
    dim: int
    embed: Callable[[Column], Column]
    text: Callable[[], Column] = field(default=lambda: T.strip(F.coalesce("text", F.lit(""))))
    payload: tuple[str, ...] = ()
    distance: str = "cosine"
    normalise: bool = True
    mode: str = "overwrite"


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


MD_SPEC = LexicalSpec({
    "chunk_id": lambda: F.col("chunk_id"), "text": lambda: T.strip(_or_empty("text")), "section": lambda: _or_empty("section"),
    "labels": lambda: F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ","), "paper_id": lambda: _or_empty("paper_id"), "year": lambda: F.lit(0),
})
TXT_SPEC = LexicalSpec({
    "chunk_id": lambda: F.col("chunk_id"), "text": lambda: T.strip(_or_empty("text")), "paper_id": lambda: _or_empty("paper_id"),
    "section": lambda: F.coalesce("section", _or_empty("section_path")), "section_path": lambda: _or_empty("section_path"), "chunk_type": lambda: F.lower(_or_empty("chunk_type")),
    "labels": lambda: F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ","), "has_math_loss": lambda: F.coalesce("has_math_loss", F.lit(False)),
    "arxiv_ids": lambda: F.array_join("harvest.arxiv_ids", ","), "emails": lambda: F.array_join("harvest.emails", ","), "urls": lambda: F.array_join("harvest.urls", ","),
})


def documents(chunks: DataFrame, spec: LexicalSpec) -> DataFrame:
    return chunks.filter(spec.keep()).select(*[c().alias(name) for name, c in spec.columns.items()])


def admission_counters(chunks: DataFrame, spec: LexicalSpec) -> DataFrame:
    return chunks.agg(F.count_if(spec.keep()).alias("indexed"), F.count_if(~spec.keep()).alias("skipped_filter"))


def postings(docs: DataFrame, key: str = "chunk_id", fields=FIELDS, terms: DataFrame | None = None) -> DataFrame:
    """(field, term, chunk_id, tf, len): how often each term (of ``terms``, if they are given) stands in each field of each document."""
    parts = [docs.select(F.lit(f).alias("field"), F.col(key).alias("chunk_id"), T.tokens(f).alias("t")) for f in fields]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rows = every.select("field", "chunk_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("field", "term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def positions(docs: DataFrame, key: str = "chunk_id", field: str = "text") -> DataFrame:
    """(term, chunk_id, pos): where each term stands in a field."""
    return docs.select(F.col(key).alias("chunk_id"), F.posexplode(T.tokens(field)).alias("pos", "term")).select("term", "chunk_id", "pos")


def field_stats(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(field, n_docs, avg_len); a document without a term in a field has length 0 there."""
    cols = [F.struct(F.lit(f).alias("field"), T.token_count(f).alias("len")) for f in fields]
    return docs.select(F.inline(F.array(*cols))).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def build_lexical(chunks: DataFrame, path: str, spec: LexicalSpec) -> DataFrame:
    """Writes docs, postings (with df, clustered by term) and stats; the counters come back."""
    docs = documents(chunks, spec)
    post = postings(docs, spec.key, spec.fields)
    docs.write.mode(spec.mode).parquet(f"{path}/docs")
    post.join(document_frequency(post), ["field", "term"]).repartitionByRange("term").sortWithinPartitions("term").write.mode(spec.mode).parquet(f"{path}/postings")
    field_stats(docs, spec.fields).write.mode(spec.mode).parquet(f"{path}/stats")
    return admission_counters(chunks, spec)


def lexical_store(spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS, buckets: int = 64) -> Store:
    """A store of documents that keeps postings and lengths with them: what a merge touches is indexed again, nothing else."""
    lengths = lambda d: d.select("chunk_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), T.token_count(f).alias("len")) for f in fields])))
    return Store(spark, path, "chunk_id", buckets, {"postings": lambda d: postings(d, "chunk_id", fields), "lengths": lengths})


def open_lexical(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """docs, postings and stats of a built index, or of the newest version of an upserted one."""
    store = lexical_store(spark, path)
    if not store.exists():
        return {k: spark.read.parquet(f"{path}/{k}") for k in ("docs", "postings", "stats")}
    stats = store.read("lengths").groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    return {"docs": store.read(), "postings": store.read("postings"), "stats": stats}


def open_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a built collection, or of the newest version of an upserted one."""
    store = Store(spark, path, "chunk_id")
    return store.read() if store.exists() else spark.read.parquet(path)


def points(chunks: DataFrame, spec: VectorSpec) -> DataFrame:
    """(point_id, chunk_id, vec, payload...) of all chunks with text."""
    kept = chunks.withColumn("_text", spec.text()).filter("_text <> ''")
    kept = kept.withColumn("_vec", spec.embed(F.col("_text")))  # a column first: models are Python functions, which lambdas can't hold
    return kept.select(T.stable_int_id("chunk_id").alias("point_id"), "chunk_id", (T.normalised("_vec") if spec.normalise else F.col("_vec")).cast("array<float>").alias("vec"), *[c for c in spec.payload if c != "chunk_id"])


def collection_dim(vectors: DataFrame) -> int:
    """The one vector length of a collection; more than one is an error."""
    sizes = [r[0] for r in vectors.filter("vec IS NOT NULL").select(F.size("vec").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes}")
    return sizes[0] if sizes else 0


def check_dims(collection: str, found: int, model: int, expected: int | None = None) -> None:
    for what, a, b in (("collection and settings", found, expected), ("model and settings", model, expected), ("model and collection", model, found)):
        if a and b and a != b:
            raise ValueError(f"{collection}: {what} differ in dimension: {a} and {b}")


def build_vectors(chunks: DataFrame, path: str, spec: VectorSpec) -> DataFrame:
    got = points(chunks, spec)
    got.write.mode(spec.mode).parquet(f"{path}/{spec.collection}")
    check_dims(spec.collection, collection_dim(chunks.sparkSession.read.parquet(f"{path}/{spec.collection}")), spec.dim, spec.dim)
    blank = spec.text() == ""
    return chunks.agg(F.count_if(~blank).alias("indexed"), F.count_if(blank).alias("skipped_empty_text"))
