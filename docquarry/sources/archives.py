"""Source archives: tar, gzip or plain TeX in, one row a text file out."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b"
_DAMAGE = (EOFError, OSError, zlib.error)
MEMBER = "path string, content binary, kind string"


def safe_path(name: str) -> str | None:
    """The member's path inside the archive; null if it leads out of it."""
    at = posixpath.normpath(posixpath.join("/root", name))
    return at[len("/root/") :] if at.startswith("/root/") else None


def inner_name(header: str | None, ident: str) -> str:
    m = re.search(r'filename="?([^";]+)"?', header or "")
    name = m[1] if m else f"{ident}.tex"
    name = name[:-3] if name.endswith(".gz") else name
    return posixpath.basename(name if name.lower().endswith(".tex") else f"{name}.tex")


def members(content: bytes | None, header: str | None, ident: str):
    """(path, bytes, kind) of every file in an archive; nothing for binary data of no known kind."""
    if not content:
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
            for m in tar.getmembers():
                path = safe_path(m.name)
                if path and m.isfile():
                    yield path, tar.extractfile(m).read(), "tar"
            return
    except (tarfile.TarError, *_DAMAGE):
        pass
    if content[:2] == MAGIC:
        try:
            yield inner_name(header, ident), gzip.decompress(content), "gzip"
        except _DAMAGE:  # cut short or damaged: the archive gives nothing, the job goes on
            return
    elif b"\x00" not in content:
        yield inner_name(header, ident), content, "plain"


def expand(archives: DataFrame, id_col: str = "paper", content_col: str = "content", header_col: str | None = None) -> DataFrame:
    """(paper, path, text, kind): text is UTF-8, else Latin-1."""
    header = F.col(header_col) if header_col else F.lit(None).cast("string")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(r.paper, *m) for r in b.itertuples() for m in members(r.content, r.header, str(r.paper))]
            yield pd.DataFrame(rows, columns=["paper", "path", "content", "kind"])

    got = archives.select(F.col(id_col).cast("string").alias("paper"), F.col(content_col).alias("content"), header.alias("header")).mapInPandas(run, f"paper string, {MEMBER}")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return got.select("paper", "path", text.alias("text"), "kind")


def read_tree(spark: SparkSession, root: str, glob: str = "*.tex") -> DataFrame:
    """(path, text) of all files under ``root``, bad bytes left out."""
    from ..functions.text import drop_invalid

    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return got.select("path", drop_invalid("content").alias("text"))
