"""Shared parts of the training-data operators: folders that all executors see, staged tables, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, and what words are, in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A Python worker gets a batch of at most so many rows and about so many bytes: whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode (tests), else an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def bounded_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds of Arrow batches for what runs inside; the session's own settings come back."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_open: list[list[str]] = []


def stage(df: DataFrame, name: str, rows: int = BATCH_ROWS, frame: int = -1) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: lineage is cut, any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"
    if len(_open) >= -frame:
        _open[frame].append(path)
    with bounded_batches(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def result(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Stage what leaves a ``scratch``: it belongs to the scratch around it, or to the caller."""
    return stage(df, name, rows, frame=-2)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, also after an error."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return freed memory to the system: a Python worker goes on to other stages, and its size counts there."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def leaving_nothing(run: Callable, forget: Callable | None = None) -> Callable:
    """``run`` for mapInArrow; when a task ends, ``forget`` empties the worker's caches and free memory is given back."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _contracted(links: DataFrame) -> DataFrame:
    """The same components from fewer links: each task replaces its links by one from every node to its local root."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        def flush():
            nodes = [x for x in parent if root(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:  # bounds a task's memory; what is left is linked by the steps after
                yield from flush()
                parent.clear()
        yield from flush()

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


#: Links that a task contracts at most.
TASK_LINKS = 500_000


def connected_components(links: DataFrame, max_rounds: int = 64, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) of every node that ``links`` (a, b long) names; component is the smallest node reachable.

    Up to ``task_links`` links are contracted by one task, and its result is final. Of more, each task contracts its own,
    and large-star and small-star steps alternate (Kiveris et al. 2014) until nothing changes. A step is two aggregations and two joins; no step gathers a
    component in one task: nodes with many neighbours are met by the joins, which adaptive execution splits.
    """
    with scratch(links.sparkSession):
        return result(_settled(links, max_rounds, task_links), "components")


def _settled(links: DataFrame, max_rounds: int, task_links: int) -> DataFrame:
    ends = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    links = stage(links, "cc")
    tasks = -(-links.count() // task_links) if task_links else 0
    edges = stage(_contracted(links.coalesce(1)) if tasks <= 1 and task_links else ends(_contracted(links)), "cc")
    before = None if tasks <= 1 and task_links else mark(edges)
    for _ in range(max_rounds):
        if before is None:
            break
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stage(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"), "cc")
        # small star: every smaller neighbour of a node, and the node, goes to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stage(ends(small), "cc")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def meetings(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, other): every block (keys, block, blocks, m) with itself, where other is null, and with every later block of its bucket."""
    several = blocks.filter("blocks > 1")
    later = F.explode(F.expr("CASE WHEN block + 1 < blocks THEN sequence(block + 1, blocks - 1) ELSE array() END")).alias("block")
    pairs = several.select(*keys, "m", later).join(several.select(*keys, "block", F.col("m").alias("other")), [*keys, "block"])
    alone = blocks.select(*keys, "m", F.lit(None).cast(blocks.schema["m"].dataType).alias("other"))
    return alone.unionByName(pairs.select(*keys, "m", "other"))
