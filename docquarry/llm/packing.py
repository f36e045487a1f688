"""Best-fit packing by a configuration linear program over the length histogram.

1. Python workers tokenise whole texts (Arrow batches) and cut them into pieces; each piece is numbered within its task
   and length. Only the pieces' lengths and checksums are staged.
2. The histogram (at most ``capacity`` rows) goes to the driver. The linear program "fewest sequences whose
   configurations cover every length" is solved by multiplicative weights; each step's configurations are priced by a
   knapsack dynamic program and used in whole numbers. What the program leaves is placed by best fit over the histogram;
   the plan is never longer than best fit alone, and its dual gives a lower bound. It is a list of runs (configuration,
   times): its size depends on ``capacity`` only.
3. Pieces get a rank within their length from per-task counts and look their place up in the plan: no piece is ever
   sorted, and no group is gathered.

Nulls: a null text is empty (its document is the end token alone), a null id is kept. Repeated rows are documents of
their own. An empty table gives an empty result. Other columns are ignored. The string of an added token becomes that
token's id, as the ``tokenizers`` library does by default; no other special tokens are added.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import leaving_nothing, result, scratch, stage, table

CAPACITY, END_ID = 1024, 2
#: Words that a worker's cache holds at most; others are tokenised each time.
CACHE_WORDS = 200_000
_tokenizers: dict[str, "_Chunks"] = {}


class _Chunks(dict):
    """Ids, as little-endian 32-bit bytes, of a space and the word (with what clings to it) after it.

    The vocabulary's pattern starts a new token at every space between two characters that aren't white space, so a text
    can be tokenised chunk by chunk, and most chunks come again. A chunk that is empty or ends in white space doesn't
    stand alone: it has None, and a text with one is tokenised as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        added = json.load(open(path, encoding="utf-8"))["added_tokens"]
        special = {t["content"] for t in added}
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        #: Splits at added tokens, the longest first; None if there is none.
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")").split if special else None
        #: Added tokens that take white space with them, or stand only between other words, are left to the library.
        self.library = None
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            self.library = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary spells as themselves
        spelt = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(spelt[c] for c in t): i for t, i in vocab.items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str):
        ids = None if not chunk or chunk[-1].isspace() else np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(self) < CACHE_WORDS:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            try:
                return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))
            except TypeError:
                pass
        return np.array(self.encode(text), "<u4").tobytes()

    def document(self, text: str) -> bytes:
        parts = self.split(text) if self.split else [text]
        if len(parts) == 1:
            return self.ids(text)
        if self.library:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self.added[x] if k % 2 else self.ids(x) for k, x in enumerate(parts))


def _chunks(path: str) -> _Chunks:
    if path not in _tokenizers:
        _tokenizers[path] = _Chunks(path)
    return _tokenizers[path]


def document_bytes(path: str, text: str | None) -> bytes:
    """Ids of a document, its added tokens included."""
    return _chunks(path).document(text or "")


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``capacity``."""
    head = n % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]); nth counts pieces of this length in task ``part``."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows, at, bytes_ = [], [], []
            for k, text in enumerate(b.column(1)):
                ids = document_bytes(tokenizer, text.as_py()) + end
                for p, (start, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((p, start, n, zlib.crc32(own), part, seen[n]))
                    at.append(k)
                    if with_ids:
                        bytes_.append(own)
                    seen[n] += 1
            c = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(c, types, strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                cols, names = [*cols, pa.array(bytes_, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(leaving_nothing(run), schema)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(greatest value within c, the length to take there or 0) for every c up to ``capacity``; value[l] is that of length l, 0 if absent."""
    lengths = np.flatnonzero(value)
    v = value[lengths]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, "right")
        best[c] = best[c - 1]
        if k:
            total = v[:k] + best[c - lengths[:k]]
            j = int(total.argmax())
            if total[j] > best[c]:
                best[c], choice[c] = total[j], lengths[j]
    return best, choice


def configuration(choice: np.ndarray, capacity: int, first: int = 0) -> dict[int, int]:
    """The lengths of a greatest value within ``capacity``, of those with one piece of length ``first`` if it is given."""
    out: dict[int, int] = defaultdict(int)
    if first:
        out[first] = 1
    c = capacity - first
    while c > 0:
        n = int(choice[c])
        if n:
            out[n] += 1
        c -= n or 1
    return dict(out)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on the histogram: equal pieces are placed together. (configuration, times) runs."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        for room in sorted(r for r in open_ if r >= n):
            if not left:
                break
            k, runs = room // n, open_.pop(room)
            while runs and left:
                config, times = runs.pop()
                full = min(times, left // k)
                if full:
                    open_[room - k * n].append((config | {n: k}, full))
                    left -= full * k
                    times -= full
                if times and left:
                    open_[room - left * n].append((config | {n: left}, 1))
                    left, times = 0, times - 1
                if times:
                    runs.append((config, times))
            if runs:
                open_[room] += runs
        k = capacity // n
        if left // k:
            open_[capacity - k * n].append(({n: k}, left // k))
        if left % k:
            open_[capacity - left % k * n].append(({n: left % k}, 1))
    return [run for runs in open_.values() for run in runs]


#: (rate of the prices, slack of a configuration's price, share of the scarcest length that a step takes, steps).
_PROGRAMS = ((4.0, 1e-3, 0.1, 120), (4.0, 1e-2, 0.25, 80), (3.0, 3e-2, 0.25, 80), (4.0, 1e-1, 0.1, 80))


def _solutions(counts: np.ndarray, capacity: int, rate: float, slack: float, part: float, steps: int):
    """The configuration program by multiplicative weights: (configurations so far, pieces left, lower bound) after each step.

    A length's price is its part of a sequence times a weight that falls exponentially with the share of its pieces already
    covered. The knapsack program prices, for each length, the best configuration that holds it; those within ``slack`` of
    the greatest price are used, as often as ``part`` of their scarcest length allows, in whole numbers: this is the
    rounding. All lengths go down together, so what is left can be packed like the whole. Prices over the greatest price
    of a configuration are a solution of the dual program: their sum over all pieces is a lower bound.
    """
    size, left, plan = np.arange(capacity + 1), counts.copy(), []
    whole = np.maximum(counts, 1)
    for _ in range(steps):
        alive = left > 0
        if not alive.any():
            return
        share = left / whole
        price = np.where(alive, size * np.exp(rate * (share - share[alive].max())), 0)
        best, choice = knapsack(price, capacity)
        top = best[capacity]
        good = np.flatnonzero(alive & (price + best[capacity - size] >= (1 - slack) * top))
        used = False
        for n in sorted(good.tolist(), key=lambda n: (-share[n] * n, n)):
            config = configuration(choice, capacity, n)
            times = min(int(left[k]) // m for k, m in config.items())
            times = min(times, max(1, int(times * part)))
            if times > 0:
                used = True
                plan.append((config, times))
                for k, m in config.items():
                    left[k] -= m * times
        yield plan, left, float((counts * price).sum() / top)
        if not used:
            return


def packing_plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, times): together they hold exactly counts[l] pieces of each length l, in no more sequences than best fit needs.

    The solutions are tried with best fit for what is left, each time that a tenth of the tokens has gone; the fewest
    sequences win. A plan that reaches the lower bound ends the search.
    """
    size, rest = np.arange(capacity + 1), counts.astype(np.int64).copy()
    full = [({capacity: 1}, int(rest[capacity]))] if rest[capacity] else []
    rest[capacity] = 0
    tokens, many = int((rest * size).sum()), lambda plan: sum(t for _, t in plan)
    best = best_fit(rest, capacity)
    fewest, least = many(best), max(-(-tokens // capacity), int(rest[capacity // 2 + 1 :].sum()))
    for program in _PROGRAMS:
        mark = 0.9 * tokens
        for plan, left, bound in _solutions(rest, capacity, *program):
            least = max(least, math.ceil(bound - 1e-6))
            if fewest <= least:
                return full + best
            held = int((left * size).sum())
            if held <= mark:
                mark = 0.9 * held
                filled = best_fit(left, capacity)
                if (n := many(plan) + many(filled)) < fewest:
                    fewest, best = n, plan + filled
    return full + best


def _lookup(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, np.ndarray]:
    """Of each length: rows (first rank, first sequence, pieces a sequence, offset of the first), by rank."""
    rows, used, sequence = defaultdict(list), defaultdict(int), 0
    for config, times in plan:
        offset = 0
        for n, k in sorted(config.items(), reverse=True):
            rows[n].append((used[n], sequence, k, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids as 32-bit little-endian]."""
    with scratch(docs.sparkSession):
        return result(_packed(docs, tokenizer, id_col, text_col, capacity, with_ids), "packed")


def _packed(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    cut = stage(tokenised_pieces(docs, tokenizer, id_col, text_col, capacity, with_ids), "pack-pieces")
    per_task = stage(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    places = _lookup(packing_plan(counts, capacity), capacity)
    first = per_task.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    ranked = cut.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, table_ = length == n, places[int(n)]
                r = rank[own]
                row = table_[np.searchsorted(table_[:, 0], r, "right") - 1]
                nth = r - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long"
    return ranked.select(*keep, "rank").mapInArrow(leaving_nothing(run), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
