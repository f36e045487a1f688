"""Personal data: exact patterns as seeds, then bootstrapped contextual extraction.

1. One scan finds the base spans (seeds) and every other place that has the wider shape of a kind: a spelt-out address, a
   local phone number, a number that fails the check digit. Both come with their contexts, the one to three tokens before
   and after, and are staged with the row's number; all that follows joins these tables. The scans are linear in the text:
   they start only where a match can start.
2. A context of a kind and side is a pattern, the text found is an instance of it. A second scan counts how often the
   tokens of each context that stands beside ``MIN_VALUES`` different instances occur anywhere, so a common word that merely
   happens to stand beside identifiers has a confidence near 0, and a longer context around it may still have a high one.
3. The pattern-instance graph is scored in rounds. Seeds have the trust 1. A pattern's confidence is the trust of its
   occurrences over all occurrences of its tokens (plus one). Patterns of at least ``SURE`` with ``MIN_VALUES`` different trusted
   instances give their confidence to their other instances; these induce further patterns in the next round, until a
   round finds no new pattern. A confidence or trust once given stays, so there are no more rounds than patterns.
4. Wider shapes beside a sure pattern become further spans, unless they overlap a base span or an earlier one. Base spans
   always stay.

Patterns and instances are known by 64-bit hashes, so their length doesn't matter.

Nulls: a null text is empty and has no spans; a null id is kept. Repeated rows each get their spans. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import result, scratch, stage, table

KINDS = ("email", "ip", "card", "phone")
MIN_VALUES, SURE, CONTEXT = 3, 0.6, 3
#: Contexts are broadcast up to this many (8 bytes each); beyond, the counts of all contexts are joined instead.
BROADCAST_CONTEXTS = 2_000_000
CACHE_TOKENS = 200_000

_digit = re.compile(r"[0-9]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What an instance may look like that is no base span; an address is looked for from its sign or the word for it.
_at = re.compile(r"\s?(?:@|\(at\)|\[at\])\s?|\sat\s", re.I)
_spelt = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I)
_WIDE = {
    1: re.compile(r"(?<![\w@.+:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w@])"),
    2: re.compile(r"(?<![\w@.+])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w@])"),
    3: re.compile(r"(?<![\w@.+])\(?[0-9][\x20().0-9/-]{5,20}[0-9](?![\w@])"),
}
_token = re.compile(r"\w+|[^\w\s]")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local_chars:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every wider shape, kinds apart."""
    out, end = [], 0
    for m in _at.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _local_chars:
            start -= 1
        found = _spelt.match(text, m.end()) if start < m.start() else None
        if found:
            end = found.end()
            out.append((start, 0, end))
    if _digit.search(text):
        out += [(m.start(), k, m.end()) for k, shape in _WIDE.items() for m in shape.finditer(text)]
    return out


class _Tokens(dict):
    """The hash of a token in lower case."""

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token.lower())
        if len(self) < CACHE_TOKENS:
            self[token] = h
        return h


_tokens = _Tokens()


def contexts(hashes: np.ndarray) -> list[np.ndarray]:
    """Of token hashes: the contexts of 1, 2, ... CONTEXT tokens that begin at each token."""
    out, h = [], np.zeros(len(hashes), np.uint64)
    for n in range(CONTEXT):
        h = h[: max(0, len(hashes) - n)] * _K[0] + hashes[n:]
        h = (h ^ (h >> np.uint64(31))) * _K[1] + np.uint64(n)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return out


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_tokens.__getitem__, tokens), np.uint64, len(tokens))


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans and wider shapes that overlap none, with their contexts before and after."""
    ends = [e for _, _, e in base]  # base spans may overlap between kinds, so the running maximum counts
    for k in range(1, len(ends)):
        ends[k] = max(ends[k], ends[k - 1])
    starts = [s for s, _, _ in base]
    clear = lambda s, e: not (n := bisect_left(starts, e)) or ends[n - 1] <= s
    found = [(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in wide_spans(text) if clear(s, e)]
    if not found:
        return []
    tokens = list(_token.finditer(text))
    begins, closes = [m.start() for m in tokens], [m.end() for m in tokens]
    at = contexts(_hashes([m[0] for m in tokens]))
    out = []
    for s, k, e, seed in found:
        i, j = bisect_right(closes, s), bisect_left(begins, e)
        left = [int(at[n][i - n - 1]) for n in range(CONTEXT) if i > n]
        right = [int(at[n][j]) for n in range(CONTEXT) if j + n < len(tokens)]
        value = int(np.uint64(xxhash.xxh3_64_intdigest(text[s:e])).astype(np.int64))
        out.append({"kind": k, "start": s, "end": e, "value": value, "seed": seed, "left": left, "right": right})
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_MENTION = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("seed", pa.bool_()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, spans, mentions); uid numbers the rows and has to be staged with them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            spans, around = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                own = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                around.append(mentions(text, own))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), b.column(0), pa.array(spans, _SPAN), pa.array(around, _MENTION)], names=["uid", "doc_id", "spans", "mentions"])
            uid += n

    schema = f"uid long, doc_id {kind}, spans array<struct<start:long,kind:int,end:long>>, mentions array<struct<kind:int,start:long,end:long,value:long,seed:boolean,left:array<long>,right:array<long>>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def context_totals(docs: DataFrame, text_col: str, wanted: DataFrame, broadcast_contexts: int = BROADCAST_CONTEXTS) -> DataFrame:
    """(context, total): how often each of ``wanted`` (context, distinct) occurs in the corpus."""
    n = wanted.count()
    few = n <= broadcast_contexts
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["context"].to_numpy()) if few else None)

    def run(batches):
        want = shared.value
        total = np.zeros(n if few else 0, np.int64)
        for b in batches:
            every = [h for x in b.column(0) if (t := x.as_py()) for h in contexts(_hashes(_token.findall(t)))]
            h = np.concatenate(every) if every else np.empty(0, np.int64)
            if few and n:
                at = np.minimum(np.searchsorted(want, h), n - 1)
                total += np.bincount(at[want[at] == h], minlength=n)
            elif not few:
                u, c = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["context", "n"])
        if few:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(want[at], pa.int64()), pa.array(total[at])], names=["context", "n"])

    every = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("total"))
    return every if few else every.join(wanted, "context", "left_semi")


def score_graph(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(kind, side, context, confidence) of the sure patterns. edges: kind, side, context, value, seed, n, each instance of a pattern once."""
    key = ["kind", "side", "context"]
    trusted = edges.filter("seed").select("kind", "value").distinct().withColumn("trust", F.lit(1.0))
    sure = None
    while True:
        mass = edges.join(trusted, ["kind", "value"]).groupBy(*key).agg(F.sum(F.col("n") * F.col("trust")).alias("mass"), F.count(F.lit(1)).alias("values")).filter(F.col("values") >= MIN_VALUES)
        new = mass.join(totals, "context").select(*key, (F.col("mass") / (F.col("total") + 1)).alias("confidence")).filter(F.col("confidence") >= SURE)
        new = stage(new if sure is None else new.join(sure, key, "left_anti"), "pii-patterns")
        if sure is not None and new.isEmpty():
            return sure
        sure = new if sure is None else stage(sure.unionByName(new), "pii-sure")
        given = edges.join(new, key).groupBy("kind", "value").agg(F.max("confidence").alias("trust")).join(trusted, ["kind", "value"], "left_anti")
        trusted = stage(trusted.unionByName(given), "pii-trusted")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the exact patterns), spans (with what the method adds): arrays of (start, kind, end)."""
    with scratch(docs.sparkSession):
        return result(_found(docs, id_col, text_col), "pii")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    every = stage(scan(docs, id_col, text_col), "pii-scan")
    sided = lambda name, side: F.transform(name, lambda c: F.struct(F.lit(side).alias("side"), c.alias("context")))
    beside = every.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*").withColumn("p", F.explode(F.concat(sided("left", "L"), sided("right", "R"))))
    beside = stage(beside.select("uid", "kind", "start", "end", "value", "seed", "p.side", "p.context"), "pii-beside")
    key = ["kind", "side", "context"]
    edges = beside.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    often = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= MIN_VALUES).select(*key)
    edges = stage(edges.join(often, key), "pii-edges")
    totals = stage(context_totals(docs, text_col, edges.select("context").distinct()), "pii-totals")
    sure = score_graph(edges, totals)
    added = beside.filter("NOT seed").join(sure.select(*key), key).groupBy("uid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))  # a row's own spans
    rows = every.select("doc_id", "uid", F.col("spans").alias("base")).join(added, "uid", "left")

    def apart(acc, x):
        clash = F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    more = F.aggregate(F.array_sort("added"), F.expr("cast(array() AS array<struct<start:long,kind:int,end:long>>)"), apart)
    return rows.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", more))).alias("spans"))


def _digest(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda x, k=k: x["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"))
