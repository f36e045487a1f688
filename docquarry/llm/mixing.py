"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame operations only.

1. Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all tokens;
   no target exceeds ``max_repeat`` times its source's size, and what is cut goes to the others by weight.
2. Schedule: slot i carries the point frac(i * golden ratio), which the cumulative targets map to a source. Slots are
   ranked within their source; the slot of rank r takes block r of that source's line. A source stops when its target is
   reached (its last slot is shorter); the few slots that the sequence's discrepancy leaves it short follow at the end.
3. A source's line is its documents in shuffled order (by a seeded hash), repeated, cut into blocks of ``block_tokens``.
   Blocks and slots meet in an equi-join on (source, block).

Running sums and ranks never run over a whole source in one task: they are taken within hash ranges (or chunks of
slots) of bounded size, then shifted by the sums of the ranges before.

Nulls: null text has size 0, a null source is a source of its own; documents of size 0 are never taken. Repeated rows are
documents of their own. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stage, table

WEIGHTS, SHARE, MAX_REPEAT, BLOCK_TOKENS, SEED = (3, 1, 2), 1.5, 2, 1024, 17
_RANGE_ROWS, _CHUNK, _CELLS = 2_000, 4096, 4096


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(doc_id, source, size, row_key): row_key shuffles the line and is the same wherever a row is read."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), row_key(id_col, text_col, source_col, seed).alias("row_key"))


def row_key(id_col: str, text_col: str, source_col: str, seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(sid, source, source_size, n_docs, target double): the only window over all rows here is over sources."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    # Water level: sources fill up in the order of cap / weight; the level is set by the first that does not.
    everything, before = W.partitionBy(), W.orderBy("ratio", "sid").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(everything) * float(share))
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(everything)["level"])
    return per.select("sid", "source", "source_size", "n_docs", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), "cap").alias("target"))


def schedule(per: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(sid, block, slot, tokens): which source and block each slot takes; ``per`` is a staged result of targets()."""
    spark = per.sparkSession
    quota = per.filter("target >= 0.5").select("sid", F.round("target").cast("long").alias("quota"), "target")
    total = quota.agg(F.sum("quota")).first()[0] or 0
    slots = math.ceil(total / block_tokens)
    upto = F.sum("target").over(W.orderBy("sid"))
    whole = F.sum("target").over(W.partitionBy())
    spans = quota.select("sid", "quota", (F.coalesce(F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / whole).alias("low"), (upto / whole).alias("high"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * _CELLS), F.least(F.lit(_CELLS - 1).cast("long"), F.floor(F.col("high") * _CELLS)))))
    g = (math.sqrt(5) - 1) / 2
    point = (F.shiftright("id", 20) * math.fmod(g * (1 << 20), 1.0)) % 1.0 + (F.col("id").bitwiseAND((1 << 20) - 1) * g) % 1.0
    points = spark.range(slots).select(F.col("id").alias("slot"), (point % 1.0).alias("x")).withColumn("cell", F.floor(F.col("x") * _CELLS))
    drawn = points.join(cells, "cell").filter("x >= low AND x < high").select("sid", "slot", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("sid", "chunk", (F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("start"))
    ranked = drawn.join(starts, ["sid", "chunk"]).withColumn("block", F.col("start") + F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(quota.select("sid", "quota"), "sid").filter(F.col("block") * block_tokens < F.col("quota")).select("sid", "block", "slot", "quota")
    drawn_n = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    needed = F.ceil(F.col("quota") / block_tokens).cast("long")
    short = spans.join(drawn_n, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < needed)
    tail = short.withColumn("block", F.explode(F.sequence(F.col("n"), needed - 1))).select("sid", "block", (F.col("block") + slots).alias("slot"), "quota")
    return ranked.unionByName(tail).select("sid", "block", "slot", F.least(F.lit(block_tokens).cast("long"), F.col("quota") - F.col("block") * block_tokens).alias("tokens"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS,
    weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, source, size, source_size, target, taken, first_slot, row_key, one row per document.

    first_slot: the first slot of the schedule that takes words of the document, null if none does.

    pieces: the mix itself, (slot, sid, doc_id, row_key, lap, start, length): words [start, start + length) of the
    document belong to that slot; read in the order of slot, lap and place they are the mixed stream.
    """
    sized = stage(_sized(docs, id_col, text_col, source_col, seed), "mix-sized")
    per = stage(targets(sized, weights, share, max_repeat), "mix-targets")
    slots = schedule(per, block_tokens)
    most = per.agg(F.max("n_docs")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, most / _RANGE_ROWS))))
    known = per.withColumn("_source", F.col("source")).drop("source", "n_docs")
    line = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("_source")
    line = line.withColumn("part", F.shiftrightunsigned("row_key", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = line.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = sums.select("sid", "part", (F.sum("n").over(W.partitionBy("sid").orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("size").over(W.partitionBy("sid", "part").orderBy("row_key", F.col("doc_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    line = line.join(before, ["sid", "part"]).withColumn("place", F.col("before") + within - F.col("size"))
    quota = F.round("target").cast("long")
    lap = line.filter("size > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(max_repeat) - 1))))
    lap = lap.withColumn("at", F.col("lap") * F.col("source_size") + F.col("place"))
    lap = lap.withColumn("upto", F.least(F.col("at") + F.col("size"), quota))
    cut = lap.withColumn("block", F.explode_outer(F.when(F.col("upto") > F.col("at"), F.sequence(F.expr(f"at div {block_tokens}"), F.expr(f"(upto - 1) div {block_tokens}")))))
    lo, hi = F.greatest(F.col("at"), F.col("block") * block_tokens), F.least(F.col("upto"), F.col("block") * block_tokens + F.col("tokens"))
    met = cut.join(slots, ["sid", "block"], "left").withColumn("start", lo - F.col("at")).withColumn("length", F.greatest(hi - lo, F.lit(0)))
    pieces = met.filter("length > 0").select("slot", "sid", "doc_id", "row_key", "lap", "start", "length")
    keys = ["doc_id", "row_key", "source", "sid", "place", "size", "source_size", "target"]
    taken = met.groupBy(*keys).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("taken"), F.min(F.when(F.col("length") > 0, F.col("slot"))).alias("first_slot"))
    none = line.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "row_key"]
    return taken.select(*cols).unionByName(none.select(*cols)), pieces


def mixed_documents(docs: DataFrame, columns: list[str], **how) -> DataFrame:
    """The documents of the mix: each as often as it is taken, its last turn cut where the source's target ends."""
    seed = how.get("seed", SEED)
    mixed, _ = mix_sources(docs, **how)
    counts = mixed.filter("taken > 0").groupBy("row_key").agg(F.max("taken").alias("taken"), F.max("size").alias("size"))
    counts = counts.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))))
    counts = counts.select(F.col("row_key").alias("_key"), F.least(F.col("size"), F.col("taken") - F.col("_turn") * F.col("size")).alias("_n"), F.col("size").alias("_size"))
    rows = docs.withColumn("_key", row_key("doc_id", "text", "source", seed)).join(counts, "_key")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("_n") < F.col("_size"), F.array_join(F.slice(words, 1, F.col("_n").cast("int")), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", cut).select(*columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")
