"""Keyed upserts of chunks into indexes by Structured Streaming; the latest record of a key wins.

A store keeps its rows in hash buckets of the key. A merge rewrites the buckets that it touches, and what is derived from
them (postings, statistics), under a new version; a manifest names the version of every bucket's files and is put in place
by one rename, so a reader sees all of a merge or nothing. The manifest also holds the last epoch of every writer: a batch
that comes again changes nothing, while a new stream, or one with a new checkpoint, starts its own count.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

BUCKETS = 64


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the last by ``order``: a combining aggregate, so a key with many records is reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("m"))
    return best.select(key, *[F.col("m.row")[c].alias(c) for c in rest])


class Store:
    """Rows by key under ``path``. ``derive`` has functions from the rows of some buckets to further tables of those buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", buckets: int = BUCKETS, derive: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.path, self.key, self.buckets, self.derive = spark, path, key, buckets, derive or {}
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def exists(self) -> bool:
        return any(n.endswith(".json") for n in self._names("manifest"))

    def manifest(self) -> dict:
        """version, buckets, seen (the last epoch of each writer), at (part -> bucket -> version), schemas (of each part)."""
        versions = [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json")]
        if not versions:
            return {"version": 0, "buckets": self.buckets, "seen": {}, "at": {}, "schemas": {}}
        stream = self._fs.open(self._at(f"manifest/{max(versions)}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, m: dict) -> None:
        being, done = self._at(f"manifest/{m['version']}.tmp"), self._at(f"manifest/{m['version']}.json")
        out = self._fs.create(being, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if not self._fs.rename(being, done):
            raise RuntimeError(f"version {m['version']} of {self.path} was written by someone else")

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def _read(self, m: dict, part: str, buckets: list[int] | None = None) -> DataFrame | None:
        have = m["at"].get(part, {})
        paths = [f"{self.path}/data/{v}/{part}/bucket={b}" for b, v in have.items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(StructType.fromJson(m["schemas"][part])).parquet(*paths) if paths else None

    def read(self, part: str = "rows") -> DataFrame:
        """A part of the newest version; a part that no merge has made is an error."""
        m = self.manifest()
        if part not in m["schemas"]:
            raise ValueError(f"{self.path} has no {part}")
        got = self._read(m, part)
        got = self.spark.createDataFrame([], StructType.fromJson(m["schemas"][part])) if got is None else got
        return got

    def merge(self, batch: DataFrame, writer: str, epoch: int, order: Column | None = None) -> bool:
        """``batch`` over the rows of its keys, the last by ``order`` first; False if the writer's epoch was merged before.

        ``order`` is any orderable column that tells the records of one batch apart; without it the batch has to hold each
        key once.
        """
        m = self.manifest()
        if m["seen"].get(writer, -1) >= epoch:
            return False
        self.buckets = m["buckets"]
        n = m["version"] + 1
        at = f"{self.path}/data/{n}"
        staged = batch.withColumn("_order", order if order is not None else F.lit(0))
        latest(staged, self.key, "_order").drop("_order", "_p").withColumn("_bucket", self.bucket(self.key)).write.mode("overwrite").parquet(f"{at}/batch")
        new = self.spark.read.parquet(f"{at}/batch")
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets``
        old = self._read(m, "rows", touched)
        rows = new.drop("_bucket")
        if old is not None:
            rows = old.join(new.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True)
        parts = {"rows": rows}
        m["seen"][writer], m["version"] = epoch, n
        for part, f in [("rows", None), *self.derive.items()]:
            df = rows if f is None else f(self.spark.read.schema(parts["rows"].schema).parquet(f"{at}/rows"))
            df.withColumn("bucket", self.bucket(self.key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/{part}")
            m["schemas"][part] = df.schema.jsonValue()
            have = m["at"].setdefault(part, {})
            for b in touched:
                have.pop(str(b), None)
            have |= {x.removeprefix("bucket="): n for x in self._names(f"data/{n}/{part}") if x.startswith("bucket=")}
        self._commit(m)
        self._fs.delete(self._at(f"data/{n}/batch"), True)
        return True


def upsert_stream(spark: SparkSession, source: str, schema, store: Store, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, order: str | None = None):
    """Reads new JSON-lines files of ``source`` and merges each micro-batch; blank texts are left out. The query comes back.

    Of records with one key in a batch the greatest ``order`` wins, else the last: by the file's time, its name, and the
    place in the file.
    """
    rows = spark.readStream.schema(schema).option("mode", "FAILFAST").json(source)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    rows = rows.withColumn("_p", F.struct(F.col(order).alias("given") if order else F.lit(0).alias("given"), place.alias("file")))
    if "text" in rows.columns:
        rows = rows.filter(T.strip(F.coalesce("text", F.lit(""))) != "")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("_p", F.struct("_p", F.monotonically_increasing_id()))  # grows along a file
        store.merge(transform(batch) if transform else batch, checkpoint, epoch, F.col("_p"))

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_point_ids(vec: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """For vector upserts: points keyed by the stable hash of the chunk id."""
    return lambda df: df.withColumn("point_id", T.stable_int_id("chunk_id")).withColumn("vec", vec(F.col("text"))).withColumn("vec", T.normalised("vec"))
