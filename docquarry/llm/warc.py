"""Content-addressed web archive: payloads once by strong digest, exact record headers apart, records by a join.

Layout: ``payloads`` (digest = SHA-256, zstd-compressed bytes, holder) and ``headers`` (the exact bytes of each record's
WARC and HTTP headers, and the digest). Equal payloads are combined before the shuffle by digest *and* bytes, so two
payloads under one digest would show as two rows; writing stops then. Reading joins headers to payloads, recomputes the
digest of what it read, and stops if it differs. ``export_warc`` writes the joined records as WARC files. ``read_warc``
splits WARC files of any origin into records; ``archive_records`` and ``restore_records`` keep and rebuild them to the byte.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest id is the response and the
others are revisits that refer to it; smaller ones are all responses.

Nulls: a null payload is empty, a null URL is the empty URI. A null id never holds a payload that a row with an id has; if
no row has an id, all are responses. Repeated rows with the largest id are all responses. Empty tables give empty
archives. Other columns are ignored. A WARC file is read as a whole by one task; an empty file has no records, and a
damaged one stops the job.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, result, scratch, shared_dir, stage, table

REVISIT_BYTES, LEVEL = 1000, 3
DATE = "2024-01-01T00:00:00Z"
_URN, _PROFILE = "urn:page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(html_col: str) -> Column:
    return F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")


def _compressed(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(digest, size, zbytes, page_id): equal bytes give equal compressed bytes."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        for b in batches:
            raw = [x.as_py() for x in b.column(1)]
            cols = [pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([len(x) for x in raw], pa.int64()), pa.array([zip_.compress(x) for x in raw], pa.binary()), b.column(0)]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "size", "zbytes", "page_id"])

    return pages.select(F.col(id_col).cast("long"), _payload(html_col)).mapInArrow(run, "digest string, size long, zbytes binary, page_id long")


def _one_each(store: DataFrame) -> None:
    if not store.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("two payloads have one digest")


def _unpacked(unzip: zstandard.ZstdDecompressor, digest: str, size: int, z: bytes) -> bytes:
    raw = unzip.decompress(z, max_output_size=max(1, size)) if size else b""
    if len(raw) != size or hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"payload {digest} is damaged")
    return raw


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    spark = pages.sparkSession
    stored = _compressed(pages, id_col, html_col).groupBy("digest", "size", "zbytes").agg(F.max("page_id").alias("holder"))
    with bounded_batches(spark, 500):
        stored.write.parquet(f"{path}/payloads")
    store = spark.read.parquet(f"{path}/payloads").select("digest", "holder", "size")
    _one_each(store)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.sha2(_payload(html_col), 256).alias("digest"), F.sha1(_payload(html_col)).alias("sha1"))
    rows = rows.join(store, "digest")
    revisit = (F.col("size") >= revisit_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    warc = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{_URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <{_URN}"), F.col("holder"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("size")), F.lit("\r\n\r\n"),
    )
    heads = rows.withColumn("http", http).select("page_id", "digest", F.encode(warc, "UTF-8").alias("warc_head"), F.encode("http", "UTF-8").alias("http_head"))
    heads.write.option("compression", "zstd").parquet(f"{path}/headers")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines if ": " in x)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record, rebuilt by the join: page_id, url, record_type, refers_to, payload_bytes, payload_digest (SHA-1)[, warc_head, http_head, payload].

    The record's bytes are warc_head + http_head + (payload unless it is a revisit) + CRLF CRLF.
    """
    heads, store = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        last, found = None, None
        for b in batches:
            out = []
            for page_id, digest, warc, http, size, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if digest != last:
                    raw = _unpacked(unzip, digest, size, z)
                    last, found = digest, (raw, hashlib.sha1(raw).hexdigest())
                raw, sha1 = found
                f = _fields(warc)
                kind = f["WARC-Type"]
                if f["WARC-Payload-Digest"] != f"sha1:{sha1}" or int(f["Content-Length"]) != len(http) + (len(raw) if kind == "response" else 0):
                    raise ValueError(f"record {f['WARC-Record-ID']} doesn't fit its payload")
                refers = f.get("WARC-Refers-To")
                out.append((page_id, f["WARC-Target-URI"], kind, int(refers[len(_URN) + 1 : -1]) if refers else None, len(raw), sha1, *((warc, http, raw) if with_payload else ())))
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["warc_head", "http_head", "payload"] if with_payload else [])]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] * 3 if with_payload else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(types), types, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", warc_head binary, http_head binary, payload binary" * with_payload
    return heads.join(store, "digest").select("page_id", "digest", "warc_head", "http_head", "size", "zbytes").mapInArrow(run, schema)


def export_warc(records: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """WARC files by Spark's text writer: payloads are UTF-8, and the two line ends after a record are its separator."""
    block = F.concat(F.decode("warc_head", "UTF-8"), F.decode("http_head", "UTF-8"), F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise(F.lit("")))
    records.select(block.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def split_records(data: bytes) -> list[tuple[bytes, bytes, bytes]]:
    """(WARC header, HTTP header or nothing, payload) of each record, by the records' own lengths; gzip members are opened."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) + 4
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:])}
        if end < 4 or not data.startswith(b"WARC/", at) or not named.get(b"content-length", b"").isdigit():
            raise ValueError(f"no WARC record at byte {at}")
        stop = end + int(named[b"content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} doesn't end at its length")
        body = data.find(b"\r\n\r\n", end, stop) + 4 if named.get(b"content-type", b"").lower().startswith(b"application/http") else end
        body = body if body >= end else end
        out.append((data[at:end], data[end:body], data[body:stop]))
        at = stop + 4
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, warc_head, http_head, payload: the records of the WARC files under ``path``, plain or gzip, by Spark's reader."""

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for nth, record in enumerate(split_records(data.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, nth, *record), (pa.string(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["file", "nth", "warc_head", "http_head", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, nth long, warc_head binary, http_head binary, payload binary")


def archive_records(records: DataFrame, path: str) -> None:
    """Keep the records of ``read_warc``: exact headers with the payload's digest, each payload once."""
    spark = records.sparkSession

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        for b in batches:
            raw = [x.as_py() for x in b.column(4)]
            cols = [*b.columns[:4], pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([len(x) for x in raw], pa.int64()), pa.array([zip_.compress(x) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "nth", "warc_head", "http_head", "digest", "size", "zbytes"])

    schema = "file string, nth long, warc_head binary, http_head binary, digest string, size long, zbytes binary"
    with scratch(spark):
        every = stage(records.select("file", "nth", "warc_head", "http_head", "payload").mapInArrow(run, schema), "warc-records", 1)
        every.select("digest", "size", "zbytes").distinct().write.parquet(f"{path}/payloads")
        every.drop("size", "zbytes").write.option("compression", "zstd").parquet(f"{path}/headers")
    _one_each(spark.read.parquet(f"{path}/payloads"))


def restore_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``archive_records`` as ``read_warc`` gave them; in a file, by nth, each followed by CRLF CRLF, they are the file."""
    heads, store = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            raw = [_unpacked(unzip, *x) for x in zip(*(b.column(k).to_pylist() for k in (4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(raw, pa.binary())], names=["file", "nth", "warc_head", "http_head", "payload"])

    joined = heads.join(store, "digest").select("file", "nth", "warc_head", "http_head", "digest", "size", "zbytes")
    return joined.mapInArrow(run, "file string, nth long, warc_head binary, http_head binary, payload binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/docquarry/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    with scratch(spark):
        return result(read_archive(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-read", 500)


OP7_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS holder
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM g
"""
