"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Python workers hash the words of whole texts to shingle sets; equal sets (by 128-bit fingerprint) become one class with
   a number of its own. Each set gets ``BANDS`` keys of ``ROWS`` minimum hashes and, from other hash functions, a sketch of
   128 bytes.
2. Classes that share a band key form a bucket. First each member meets the bucket's member of smallest id: as many pairs
   as members. What survives is verified, at first one pair for each class, then those whose ends are still apart.
3. Buckets that still span several components are cut into blocks of about ``BLOCK`` members, which carry sketches and
   texts. Block meets block inside a worker, which verifies the survivors of different components and joins components as
   it goes: no pair ever becomes a row, and a meeting returns a forest, so fewer links than members. After it every two
   members of a bucket have met or are connected: there are no further rounds.
4. A pair that meets is compared on its sketch, 32 hashes at a time. After n hashes of which m agree, the similarity has
   the posterior Beta(m + 1, n - m + 1); the pair is dropped once P(similarity >= threshold) < ``MISS``. (Chance
   agreement of one-byte hashes only raises m, so it never drops more.) Sets whose sizes alone rule the threshold out
   are not compared.
5. Survivors are verified on full sets, and components come from large-star / small-star.

A pair of similarity exactly 0.8 shares no band with probability (1 - 0.8^8)^64 = 8e-6, less above. Shingles are 64-bit
hashes of their words: full sets of n shingles differ from the sets of words themselves with probability below n^2 / 2^64.

Nulls: text null, empty or without words: no shingles, own component, kept. A null id links with nothing, its component
is null, and the row is kept. Rows that repeat an id are documents of their own, whose links hold for the id's smallest
component. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, leaving_nothing, meetings, result, scratch, stage, table

WIDTH, THRESHOLD = 5, 80  # words a shingle, similarity in percent
BANDS, ROWS, SKETCH, BATCH, MISS = 64, 8, 128, 32, 1e-6
#: Members, and shingles, of a block; pairs with one hub that one task verifies; meetings in an Arrow batch.
BLOCK, BLOCK_SHINGLES, HUB, BATCH_BLOCKS = 512, 1 << 19, 4096, 32
#: Ids are broadcast to the document scan up to this many (16 MB); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
CACHE_WORDS = 100_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS + SKETCH, np.uint32) | np.uint32(1))
_B = _rng.integers(0, 1 << 32, BANDS * ROWS + SKETCH, np.uint32)
_K = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_words = _Words()


def _forget() -> None:
    _words.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; one for the whole of a text of fewer words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        s = s + _mixed(h[k : len(h) - width + 1 + k] ^ _K[k]) * _K[k]
    return np.unique(_mixed(s))


def minima(s: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the set."""
    h, low = (s >> np.uint64(32)).astype(np.uint32)[:, None], np.full(_A.size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 64):  # a block of hashes stays in the processor's cache
        x = h[k : k + 64] * _A
        x += _B
        np.minimum(low, x.min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((_mixed(rows * _K[:ROWS]) * _K[ROWS : 2 * ROWS]).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def least_agreement(n: int, threshold: float, miss: float = MISS) -> int:
    """The fewest agreements of n hashes at which P(similarity >= threshold) is still ``miss`` or more."""
    # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, fp, bands, sketch); fp, bands and sketch are null where there are no shingles."""

    def run(batches):
        for b in batches:
            n, fp, bands, sketch = [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                if not len(s):
                    fp.append(None), bands.append(None), sketch.append(None)
                    continue
                low = minima(s)
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(low))
                sketch.append(((low[BANDS * ROWS :] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "fp", "bands", "sketch"])

    schema = "doc_id long, n_shingles long, fp binary, bands array<long>, sketch binary"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(leaving_nothing(run, _forget), schema)


def _bounds(threshold: float) -> list[tuple[int, int]]:
    return [(n, least_agreement(n, threshold)) for n in range(BATCH, SKETCH + 1, BATCH)]


def _alive(x: np.ndarray, y: np.ndarray, bounds) -> tuple[np.ndarray, np.ndarray]:
    """(positions that the Bayesian test keeps, their agreements); x and y are sketches, row by row or one against many."""
    alive, agree = np.arange(len(y)), np.zeros(len(y), np.int64)
    for n, least in bounds:
        own = x[n - BATCH : n] if x.ndim == 1 else x[alive, n - BATCH : n]
        agree = agree + (own == y[alive, n - BATCH : n]).sum(axis=1)
        keep = agree >= least
        alive, agree = alive[keep], agree[keep]
        if not len(alive):
            break
    return alive, agree


def _survivors(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, agree) that the Bayesian test keeps."""
    x, y = (classes.select(F.col("cls").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    bounds = _bounds(threshold)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
                alive, agree = _alive(p, q, bounds)
                at = pa.array(alive)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(agree)], names=["a", "b", "agree"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(leaving_nothing(run), "a long, b long, agree long")


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(cls, z): the compressed text of one document of each class of ``wanted`` (cls)."""
    own = classes.join(wanted.distinct(), "cls", "left_semi").select("cls", "fp", "first")
    own = stage(own, "near-wanted")
    ids = own.select(F.col("first").alias("_id")).distinct()
    if own.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            fp, z = [], []
            for text in b.column(0):
                text = text.as_py()
                s = shingles(text, width)
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                z.append(zip_.compress(text.encode()) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(z, pa.binary())], names=["fp", "z"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(ids, "_id", "left_semi")
    found = texts.select("_text").mapInArrow(leaving_nothing(run, _forget), "fp binary, z binary").join(own.select("cls", "fp"), "fp")
    return stage(found.groupBy("cls").agg(F.min("z").alias("z")), "near-texts")  # the same text may come again under its id


def _unpacked(z: bytes, width: int) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(z).decode(), width)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The text of ``a`` comes once for at most ``HUB`` of its pairs, before them in the order of the sort.
    """
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / HUB).cast("int").alias("k"))
    leaves = pairs.select("a", "b").join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"), "b")
    leaves = leaves.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "z")
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part")).join(texts.withColumnRenamed("cls", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "z")
    dealt = heads.unionByName(leaves).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        hub = None
        for batch in batches:
            keep = []
            for k, (b, z) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = _unpacked(z, width)
                if b is None:
                    hub = own
                elif _similar(hub, own, percent):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at)], names=["a", "b"])

    return dealt.mapInArrow(leaving_nothing(run, _forget), "a long, b long")


def _blocks(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, block, blocks, m): the members (key, cls, n, c) of each bucket in blocks of about BLOCK members and BLOCK_SHINGLES shingles."""
    size = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(size, "key").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    full = placed.join(classes.select("cls", "sketch").join(texts, "cls"), "cls")  # dealt by class now, so that the blocks of one bucket go to different tasks
    return stage(full.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("cls", "n", "c", "sketch", "z")).alias("m")), "near-blocks")


class _Met:
    """The members of one meeting: candidates are pairs of different components whose sizes and sketches leave the threshold possible."""

    def __init__(self, m: list[dict], other: list[dict] | None, percent: int):
        self.rows = m + (other or [])
        self.cls, self.n, comp = (np.array([r[k] for r in self.rows], np.int64) for k in ("cls", "n", "c"))
        self.c = np.unique(comp, return_inverse=True)[1]
        self.sketch = np.frombuffer(b"".join(r["sketch"] for r in self.rows), np.uint8).reshape(-1, SKETCH)
        self.left, self.cross, self.percent = len(m), other is not None, percent
        self.bounds = _bounds(percent / 100)

    def candidates(self):
        """(i, positions) by i; reads the components anew for each i."""
        for i in range(self.left if self.cross else len(self.rows) - 1):
            begin = self.left if self.cross else i + 1
            n = self.n[begin:]
            j = begin + np.flatnonzero((self.c[begin:] != self.c[i]) & (100 * n >= self.percent * self.n[i]) & (100 * self.n[i] >= self.percent * n))
            if len(j):
                j = j[_alive(self.sketch[i], self.sketch[j], self.bounds)[0]]
                if len(j):
                    yield i, j


def _joined(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what similar members connect: a forest for each meeting. Texts are unpacked when a pair survives."""

    def run(batches):
        for b in batches:
            for m, other in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                met, sets, links = _Met(m, other, percent), {}, []

                def own(k, met=met, sets=sets):
                    if k not in sets:
                        sets[k] = _unpacked(met.rows[k]["z"], width)
                    return sets[k]

                for i, j in met.candidates():
                    for k in j.tolist():
                        if met.c[k] != met.c[i] and _similar(own(i), own(k), percent):
                            links.append((met.cls[i], met.cls[k]))
                            met.c[met.c == met.c[k]] = met.c[i]
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links, strict=True)], names=["a", "b"])

    return meetings(blocks, ["key"]).mapInArrow(leaving_nothing(run, _forget), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    with scratch(docs.sparkSession):
        return result(_near(docs, id_col, text_col, width, percent), "near-duplicates")


def _near(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    every = stage(sketches(docs, id_col, text_col, width), "near-sketches")
    first = every.filter("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("s"))
    # the number of a class is written with it, so it stays what it is
    classes = stage(first.select(F.monotonically_increasing_id().alias("cls"), "fp", F.col("s.doc_id").alias("first"), F.col("s.n_shingles").alias("n"), "s.bands", "s.sketch"), "near-classes")
    rows = classes.select("cls", "n", "first", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min(F.struct("first", "cls", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(rows.drop("first").join(buckets, "key"), "near-buckets")

    near = lambda x, y: F.col(x) * 100 >= F.col(y) * percent
    pairs = members.filter(F.col("cls") != F.col("hub.cls")).filter(near("n", "hub.n") & near("hub.n", "n")).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct()
    pool = stage(_survivors(pairs, classes, percent / 100), "near-survivors")
    texts = _texts(pool.select(F.col("a").alias("cls")).union(pool.select("b")), classes, docs, id_col, text_col, width)
    best = pool.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("s")).select("s.a", "b")
    links = stage(_verified(best, texts, width, percent), "near-links")
    components = connected_components(links)
    here, there = (components.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    apart = pool.join(here, "a", "left").join(there, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    apart = stage(apart.join(best, ["a", "b"], "left_anti"), "near-apart")
    if not apart.isEmpty():
        links = links.unionByName(stage(_verified(apart, texts, width, percent), "near-links"))
        components = connected_components(links)

    named = members.filter("size > 2").select("key", "cls", "n").join(components.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("c"))
    named = stage(named, "near-named")
    several = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("key")
    open_ = stage(named.join(several, "key", "left_semi"), "near-open")
    if not open_.isEmpty():
        texts = _texts(open_.select("cls"), classes, docs, id_col, text_col, width)
        links = links.unionByName(stage(_joined(_blocks(open_, classes, texts), width, percent), "near-links", BATCH_BLOCKS))
        components = connected_components(links)

    labels = classes.select("cls", "fp", "first").join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    found = labels.join(least, "component").select("fp", "component_id")
    out = every.select("doc_id", "n_shingles", "fp").join(found, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: Every pair that shares a shingle, by counting; the components by reach.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda k: t[k] || ' ' || t[k + 1]) ELSE t END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 100 * p.n >= 80 * q.n AND 100 * q.n >= 80 * p.n GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), c AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
