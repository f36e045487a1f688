"""JSON lines: tolerant, strict and counting scans, chunk arrays, writers that keep nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import keyword_in_section, strip


def _typed(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def scan(spark: SparkSession, path: str, schema) -> DataFrame:
    """Every line: rec (null unless ok), disposition (ok, blank, decode_error), line, file."""
    s = T.StructType([*_typed(schema).fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.text(path).withColumn("file", F.input_file_name())
    parsed = F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    got = raw.withColumn("rec", parsed).withColumn("disposition", F.when(strip("value") == "", "blank").when(F.col("rec._corrupt").isNotNull() | F.col("rec").isNull(), "decode_error").otherwise("ok"))
    return got.select(F.when(F.col("disposition") == "ok", F.struct(*[F.col(f"rec.{f.name}").alias(f.name) for f in _typed(schema).fields])).alias("rec"), "disposition", F.col("value").alias("line"), "file")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the good lines."""
    return scan(spark, path, schema).filter("disposition = 'ok'").select("rec.*")


def read_strict(spark: SparkSession, path: str, schema) -> DataFrame:
    """A malformed line stops the job."""
    return spark.read.schema(_typed(schema)).option("mode", "FAILFAST").json(path)


def read_matches(spark: SparkSession, path: str, schema, keywords: list[str]) -> DataFrame:
    """Good lines whose section holds a keyword."""
    rows = read(spark, path, schema)
    path_col = F.col("section_path") if "section_path" in rows.columns else F.lit("")
    return rows.filter(keyword_in_section("section", path_col, keywords))


def read_arrays(spark: SparkSession, paths, schema) -> DataFrame:
    """Chunk files that hold an array or one object; ``file`` keeps their order."""
    return spark.read.schema(_typed(schema)).option("multiLine", "true").json(paths).withColumn("file_name", F.input_file_name())


def counters(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: indexed, skipped_blank, skipped_decode, skipped_filter."""
    n = lambda c: F.count_if(c)
    ok, blank = F.col("disposition") == "ok", strip(F.coalesce(F.col(f"rec.{text_col}"), F.lit(""))) == ""
    return scanned.agg(n(ok & ~blank).alias("indexed"), n(F.col("disposition") == "blank").alias("skipped_blank"), n(F.col("disposition") == "decode_error").alias("skipped_decode"), n(ok & blank).alias("skipped_filter"))


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
