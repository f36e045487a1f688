"""Exact deduplication over an extendible-hash index on shared files. DataFrame operations only.

1. Every text is normalised, hashed (64 bits) and digested once; ids, hashes and digests are staged without the texts.
2. A directory of hash prefixes over the distinct hashes is doubled until no bucket holds more than ``bucket_capacity`` of
   them. Only buckets that are overfull split, so several directory addresses may name one bucket.
3. Each hash goes to its bucket through the directory, each range of buckets to its owner task, which writes its part of
   the index as files in the shared folder. A hash that one document has is an entry at once. Of a hash that several have
   the texts are compared: equal bytes are combined before they move, what is left under one hash is a chain of collisions.
4. Every document finds its bucket through the directory and its entry in the bucket; in a chain the digest decides, which
   the comparison of bytes has shown to belong to one text.

A document whose hash is its own never sends its text anywhere; of a text with any number of copies each map task sends
one row. The directory is broadcast while it has at most ``BROADCAST_SLOTS`` addresses, beyond that it is joined.

Nulls: a null text is empty; a null id comes after every other id and never wins. Repeated rows (same id and text): the
first one stands for the document, the others are its copies. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, result, scratch, stage, table

BUCKET_CAPACITY = 100_000
#: Directory addresses (20 bytes), and hashes that several documents have (8 bytes), that are broadcast at most.
BROADCAST_SLOTS, BROADCAST_KEYS = 1_000_000, 2_000_000


def normalised(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACE, " ")


def _key(norm: Column, key_bits: int) -> Column:
    h = F.xxhash64(norm)
    return h if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - key_bits), 64 - key_bits)


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, bucket_capacity: int = BUCKET_CAPACITY, key_bits: int = 64) -> tuple[DataFrame, int]:
    """(address, bucket, local_depth) of an extendible directory over ``entries.key``, and its global depth.

    Buckets are numbered by their first address, so the order of buckets is the order of hashes.

    The counts of all depths come from one histogram; it is taken again, deeper, only while a bucket that holds
    different keys is still overfull. Its size is about twice (entries / bucket_capacity) rows.
    """
    n = entries.count()
    depth = min(key_bits, max(1, math.ceil(math.log2(max(1, n) / bucket_capacity)) + 2 if n > bucket_capacity else 1))
    while True:
        fine = entries.groupBy(_prefix(F.col("key"), depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        nodes = fine.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "p", "n").groupBy("level", F.expr(f"shiftrightunsigned(p, {depth} - level)").alias("p")).agg(F.sum("n").alias("n"))
        nodes = stage(nodes, "dedup-nodes")
        over = nodes.filter(F.col("n") > bucket_capacity)
        parents = over.select((F.col("level") + 1).alias("level"), F.col("p").alias("parent"))
        last = F.lit(min(depth, key_bits))
        leaves = nodes.filter((F.col("n") <= bucket_capacity) | (F.col("level") == last)).withColumn("parent", F.shiftright("p", 1))
        leaves = leaves.filter("level = 0").drop("parent").unionByName(leaves.filter("level > 0").join(parents, ["level", "parent"], "left_semi").drop("parent"))
        if depth >= key_bits or over.filter(F.col("level") == depth).isEmpty():
            break
        depth = min(key_bits, depth + 4)
    top = leaves.agg(F.max("level")).first()[0] or 0
    first = F.expr(f"shiftleft(p, {top} - level)")
    grown = leaves.select(F.col("level").alias("local_depth"), first.alias("bucket"), F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {top} - level)") - 1)).alias("address"))
    return grown.select("address", "bucket", "local_depth"), top


class Index:
    """The staged index: ``slots`` and ``depth`` of the directory, ``entries`` (bucket, key, chain_len, keep_id, group_size, text_sha256)."""

    def __init__(self, slots: DataFrame, depth: int, entries: DataFrame):
        self.slots, self.depth, self.entries = slots, depth, entries

    def addressed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with key) and the bucket that the directory names for them."""
        slots = self.slots.select("address", "bucket")
        if self.slots.count() <= BROADCAST_SLOTS:
            slots = F.broadcast(slots)
        return rows.withColumn("address", _prefix(F.col("key"), self.depth)).join(slots, "address").drop("address")


def _digested(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    norm = normalised(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select("doc_id", _key(F.col("norm"), key_bits).alias("key"), F.sha2("norm", 256).alias("text_sha256"))


def build_index(docs: DataFrame, digests: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_capacity: int = BUCKET_CAPACITY, key_bits: int = 64) -> Index:
    """The index over ``docs``; ``digests`` is the staged result of _digested."""
    owners = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = stage(digests.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), "dedup-keys")
    slots, depth = directory(keys, bucket_capacity, key_bits)
    index = Index(stage(slots, "dedup-slots"), depth, keys)
    one = keys.filter("n = 1").select("key", F.lit(1).cast("long").alias("chain_len"), "keep_id", F.col("n").alias("group_size"), "text_sha256")
    several = keys.filter("n > 1").select("key")
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("key", _key(F.col("norm"), key_bits))
    met = norm.join(F.broadcast(several) if several.count() <= BROADCAST_KEYS else several, "key", "left_semi")
    # the key of the grouping holds the whole text: this is the comparison of bytes
    texts = met.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = stage(texts.select("key", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")), "dedup-texts")
    length = texts.groupBy("key").agg(F.count(F.lit(1)).alias("chain_len"))
    chained = texts.join(length, "key").select("key", "chain_len", "keep_id", "group_size", "text_sha256")
    placed = index.addressed(one.unionByName(chained)).repartitionByRange(owners, "bucket", "key").sortWithinPartitions("bucket", "key", "text_sha256")
    index.entries = stage(placed.select("bucket", "key", "chain_len", "keep_id", "group_size", "text_sha256"), "dedup-index")
    return index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = BUCKET_CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    with scratch(docs.sparkSession):
        return result(_decided(docs, id_col, text_col, bucket_capacity, key_bits), "dedup")


def _decided(docs: DataFrame, id_col: str, text_col: str, bucket_capacity: int, key_bits: int) -> DataFrame:
    digests = stage(_digested(docs, id_col, text_col, key_bits), "dedup-digests")
    index = build_index(docs, digests, text_col, id_col, bucket_capacity, key_bits)
    rows = index.addressed(digests.groupBy("doc_id", "key", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    found = ["keep_id", "group_size", "text_sha256", "bucket"]
    single = index.entries.filter("chain_len = 1").drop("chain_len", "text_sha256")
    out = rows.join(single, ["bucket", "key"]).select("doc_id", "copies", *found)
    chained = index.entries.filter("chain_len > 1").drop("chain_len")
    if not chained.isEmpty():
        out = out.unionByName(rows.join(chained, ["bucket", "key", "text_sha256"]).select("doc_id", "copies", *found))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256", "bucket")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = BUCKET_CAPACITY, key_bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay by the index, with all their columns; of rows that repeat id and text the least row.

    A row is known by its id and a 64-bit hash of its text's digest. What goes is broadcast up to ``BROADCAST_KEYS`` rows;
    beyond, the rows meet it in a shuffled join.
    """
    with scratch(docs.sparkSession):
        decided = exact_dedup(docs, id_col, text_col, bucket_capacity, key_bits)
        own = decided.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text_sha256").alias("_sha")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
        odd = stage(own.filter("NOT _kept OR _rows > 1").select("_id", "_sha", "_kept"), "dedup-odd")
        rows = docs.withColumn("_i", F.col(id_col)).withColumn("_s", F.xxhash64(F.sha2(normalised(text_col), 256)))
        met = rows.join(F.broadcast(odd) if odd.count() <= BROADCAST_KEYS else odd, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha")), "left")
        once = met.filter("_sha IS NULL").select(*docs.columns)
        repeated = met.filter("_kept").groupBy("_i", "_s").agg(F.min(F.struct(*docs.columns)).alias("_row"))
        return result(once.unionByName(repeated.select("_row.*")), "distinct")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
