"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

1. Counting. Workers hash the words of whole training texts and combine words and word pairs before the shuffle; what
   goes over the network are packed arrays of hashes and counts, by filter segment. A segment is a range of hashes, so
   sorted hashes lie in the order of segments, and pairs are written as 32-bit steps from one to the next. The number of
   segments follows the text, so a segment's owner always has about ``SEGMENT_CHARS`` characters' worth of pairs.
2. The filter. An n-gram of count c has the level 1 + floor(log_1.5 c). The owner sets the bits of (n-gram, 1) ... (n-gram,
   level) in its segment, at ``BITS`` bits an item. Probing (n-gram, 1), (n-gram, 2), ... until one is absent gives the
   level back, and the level gives the expected count. Errors only raise a count; a pair's count is cut to its words'.
   Every count in a score, of words and of pairs, comes from the filter, whatever the size of the corpus.
3. Scoring. P(w | v) = (c(vw) + MU p(w)) / (c(v) + MU), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)): Dirichlet smoothing of the
   pair model with the unigram model. The text's start is a history of its own, the end is a token.
4. The filter is broadcast while its size, which is known by then, is at most ``BROADCAST_BYTES``. Beyond, texts are kept
   in blocks of about ``FLUSH_TOKENS`` tokens, as places in the block's words. A block asks the segments' owners for its
   distinct n-grams, packed as in counting; a byte comes back for each, in the same order, and meets the block. Rows are
   streamed in the order of a sort, filter or block first: no task holds what is asked of a segment at once.
5. Only the base score and n_known use exact counts. The most frequent words (at most ``HOT_WORDS``, a fixed bound) are
   broadcast with their counts; every other word of a document meets the whole vocabulary in a shuffled join.

Words are known by 64-bit hashes, pairs by 48-bit ones: a pair meets another of a billion with probability 4e-6, and the
filter's own errors are near 2e-2.

Nulls: a null text is empty (one token, the end); a null id counts as the empty text in the split. Repeated rows are
documents of their own. Without training rows N = V = 0 and every count is 0. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, leaving_nothing, result, scratch, stage, table

BASE, BITS, PROBES, MU = 1.5, 8, 5, 64.0
SEGMENT_CHARS, FLUSH_TOKENS = 8 << 20, 1 << 20
BROADCAST_BYTES, HOT_WORDS, CACHE_WORDS = 256 << 20, 1 << 20, 200_000
_END, _START = np.uint64(0xA5A5F00D12345677), np.uint64(0x5EED0FC0FFEE1235)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S31, _S29, _S32, _S16 = np.uint64(31), np.uint64(29), np.uint64(32), np.uint64(16)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_words = _Words()


def _forget() -> None:
    _words.clear()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S31)) * _K[0]
    return (h ^ (h >> _S29)) * _K[1]


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's words (A-Z lower-cased, split at white space), then the end."""
    words = (text or "").encode().lower().split()
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    h[-1] = _END
    return h


def pairs(t: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
    """The hash of each token with the one before it; ``first``: where texts begin. 48 bits, above a constant."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[first] = _START
    return (_mix(before * _K[2] + t) >> _S16 << _S16) | np.uint64(1)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges: in the order of the hashes."""
    return ((h >> _S32) * np.uint64(segments) >> _S32).astype(np.int64)


def packed(p: np.ndarray) -> bytes:
    """Pair hashes in order: the first and the 32-bit steps to the others, or all in 64 bits if a step is longer."""
    v = p >> _S16
    step = np.diff(v)
    if int(step.max(initial=0)) >> 32:
        return b"\1" + v.tobytes()
    return b"\0" + v[:1].tobytes() + step.astype(np.uint32).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    if x[0]:
        v = np.frombuffer(x, np.uint64, offset=1)
    else:
        v = np.cumsum(np.concatenate((np.frombuffer(x[1:9], np.uint64), np.frombuffer(x[9:], np.uint32).astype(np.uint64))), dtype=np.uint64)
    return (v << _S16) | np.uint64(1)


def _by_segment(w: np.ndarray, p: np.ndarray, segments: int):
    """(segment, the part of the sorted words, the part of the sorted pairs) for each segment that has any."""
    ws, ps = (np.searchsorted(segment_of(h, segments), np.arange(segments + 1)) for h in (w, p))
    for k in np.flatnonzero((np.diff(ws) > 0) | (np.diff(ps) > 0)).tolist():
        yield k, slice(ws[k], ws[k + 1]), slice(ps[k], ps[k + 1])


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


#: The expected count of a level: the middle of the counts that have it.
_MIDDLE = np.array([0.0] + [(math.ceil(BASE ** (k - 1) - 1e-9) + math.ceil(BASE**k - 1e-9) - 1) / 2 if math.ceil(BASE**k - 1e-9) > math.ceil(BASE ** (k - 1) - 1e-9) else BASE ** (k - 1) for k in range(1, 110)])


def _items(h: np.ndarray, lev: int) -> tuple[np.ndarray, np.ndarray]:
    item = _mix(h + np.uint64(lev * int(_K[3]) & 0xFFFFFFFFFFFFFFFF))
    return item, (item >> np.uint64(17)) | np.uint64(1)


def _place(item: np.ndarray, bits: np.ndarray | np.uint64) -> np.ndarray:
    return (((item >> _S32) * bits) >> _S32).astype(np.int64)


def make_segment(h: np.ndarray, count: np.ndarray) -> tuple[int, bytes]:
    """(number of bits, the bits) of a filter that holds every (n-gram, level)."""
    lev = level(count)
    bits = max(64, int(lev.sum()) * BITS)
    on = np.zeros((bits + 7) // 8 * 8, bool)
    for j in range(1, int(lev.max(initial=0)) + 1):
        item, step = _items(h[lev >= j], j)
        for _ in range(PROBES):
            on[_place(item, np.uint64(bits))] = True
            item = item * _K[0] + step
    return bits, np.packbits(on, bitorder="little").tobytes()


def probe(h: np.ndarray, bits: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Levels by repeated membership probes; bits and start (byte) belong to each n-gram's segment."""
    out, alive, j = np.zeros(len(h), np.int64), np.flatnonzero(bits), 0
    while len(alive):
        j += 1
        item, step = _items(h[alive], j)
        for _ in range(PROBES):
            at = _place(item, bits[alive].astype(np.uint64))
            hit = (data[start[alive] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive, item, step = alive[hit], item[hit], step[hit]
            item = item * _K[0] + step
        out[alive] = j
    return out


def count_ngrams(docs: DataFrame, text_col: str, segments: int) -> DataFrame:
    """(segment, bits, filter, words, counts, n, v): each segment's filter and its part of the exact vocabulary."""

    def run(batches):
        held, n = [], 0

        def flush():
            t, first = np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
            w, wc = np.unique(t, return_counts=True)
            p, pc = np.unique(pairs(t, first), return_counts=True)
            wc, pc = wc.astype(np.uint32), pc.astype(np.uint32)
            rows = [(k, w[i].tobytes(), wc[i].tobytes(), packed(p[j]), pc[j].tobytes()) for k, i, j in _by_segment(w, p, segments)]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=["segment", "w", "wc", "p", "pc"])

        for b in batches:
            for text in b.column(0):
                held.append(tokens(text.as_py()))
                n += len(held[-1])
                if n >= FLUSH_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def merge(table_: pa.Table) -> pa.Table:
        both = []
        for k, read in (("w", lambda x: np.frombuffer(x, np.uint64)), ("p", unpacked)):
            h = np.concatenate([read(x) for x in table_[k].to_pylist()])
            c = np.frombuffer(b"".join(table_[k + "c"].to_pylist()), np.uint32)
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            both.append((h[first], np.add.reduceat(c, first) if len(h) else c))
        (w, wc), (p, pc) = both
        bits, data = make_segment(np.concatenate((w, p)), np.concatenate((wc, pc)))
        values = [[table_["segment"][0].as_py()], [bits], [data], [w.view(np.int64)], [wc], [int(wc.sum())], [len(w)]]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(values, types, strict=True)], names=["segment", "bits", "filter", "words", "counts", "n", "v"])

    dealt = docs.select(F.col(text_col).cast("string")).mapInArrow(leaving_nothing(run, _forget), "segment long, w binary, wc binary, p binary, pc binary")
    return dealt.groupBy("segment").applyInArrow(merge, "segment long, bits long, filter binary, words array<long>, counts array<long>, n long, v long")


class Model:
    """What training leaves: the staged segments, their sizes, and the exact vocabulary."""

    def __init__(self, docs: DataFrame, text_col: str = "text"):
        chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
        self.segments = max(1, math.ceil(chars / SEGMENT_CHARS))
        self.parts = stage(count_ngrams(docs, text_col, self.segments), "lm-model")
        size = self.parts.agg(F.sum("n"), F.sum("v"), F.sum(F.octet_length("filter"))).first()
        self.n, self.v, self.filter_bytes = (int(x or 0) for x in size)
        self.denominator = self.n + 0.1 * (self.v + 1)
        self.vocabulary = self.parts.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
        ends = self.vocabulary.filter(F.col("word") == int(_END.astype(np.int64))).first()
        self.docs = int(ends["c"]) if ends else 0  # each training text has one end, and one start

    def hot(self, most: int = HOT_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
        """(least count, words in order, counts) of the most frequent words, never more than ``most``."""
        steps = self.vocabulary.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 4).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("q")).collect()
        least, total = (1 << 62), 0
        for r in steps:
            total += r["n"]
            if total > most:
                break
            least = r["least"]
        got = self.vocabulary.filter(F.col("c") >= least).toArrow()
        w, c = got["word"].to_numpy().view(np.uint64), got["c"].to_numpy()
        order = np.argsort(w)
        return least, w[order], c[order]

    def filter_arrays(self):
        """(bits, first byte, data) of all segments, for a broadcast."""
        bits, start, data, at = np.zeros(self.segments, np.int64), np.zeros(self.segments, np.int64), np.zeros(self.filter_bytes, np.uint8), 0
        for r in self.parts.select("segment", "bits", "filter").toLocalIterator():
            bits[r["segment"]], start[r["segment"]] = r["bits"], at
            data[at : at + len(r["filter"])] = np.frombuffer(r["filter"], np.uint8)
            at += len(r["filter"])
        return bits, start, data


def _exact(t: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of hot words, -1 for others."""
    if not len(words):
        return np.full(len(t), -1, np.int64)
    at = np.minimum(np.searchsorted(words, t), len(words) - 1)
    return np.where(words[at] == t, counts[at], -1)


def _smoothed(pair: np.ndarray, history: np.ndarray, word: np.ndarray, denominator: float) -> np.ndarray:
    pair = np.minimum(pair, np.minimum(history, word))
    return np.log10((pair + MU * (word + 0.1) / denominator) / (history + MU))


def _block(texts: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """(lengths, the words in order, the place of each token there), the last by byte and compressed."""
    w, at = np.unique(np.concatenate(texts), return_inverse=True)
    planes = np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.array([len(t) for t in texts], np.int64).tobytes(), w.tobytes(), zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _opened(size: bytes, words: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, where texts begin, words, places) of a block."""
    size = np.frombuffer(size, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(at), np.uint8).reshape(4, -1)
    return size, np.cumsum(size) - size, np.frombuffer(words, np.uint64), np.ascontiguousarray(planes.T).view("<u4").ravel()


def _scores_by_owners(blocks: DataFrame, model: Model) -> DataFrame:
    """(uid, score): the distinct n-grams of each block go to the owners of their segments, the levels come back to the block."""
    segments, starts, d = model.segments, model.docs, model.denominator

    def ask(batches):
        for b in batches:
            for uid, *block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, first, w, at = _opened(*block)
                p = np.unique(pairs(w[at], first))
                rows = [(k, uid, w[i].tobytes(), packed(p[j])) for k, i, j in _by_segment(w, p, segments)]
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["segment", "block", "w", "p"])

    def answer(batches):
        own, bits, data, rows, asked = None, 0, np.zeros(1, np.uint8), [], []

        def found():
            """The levels of what was asked of one segment; all 0 if no training text has an n-gram there."""
            h = np.concatenate(asked)
            lev = probe(h, np.full(len(h), bits if rows[0][1] == own else 0, np.int64), np.zeros(len(h), np.int64), data).astype(np.uint8)
            at = np.cumsum([0, *map(len, asked)]).tolist()
            out = [lev[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]
            cols = [pa.array(x, t) for x, t in zip((*zip(*rows, strict=True), out[::2], out[1::2]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            rows.clear(), asked.clear()
            return pa.RecordBatch.from_arrays(cols, names=["block", "segment", "w", "p"])

        for b in batches:
            for segment, block, size, w, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][1] != segment:
                    yield found()
                if block is None:
                    own, bits, data = segment, size, np.frombuffer(w, np.uint8)
                else:
                    rows.append((block, segment))
                    asked.extend((np.frombuffer(w, np.uint64), unpacked(p)))
            if rows:
                yield found()

    def scored(batches):
        uid, block, got = None, None, []

        def done():
            size, first, w, at = _opened(*block)
            words, levels = (np.frombuffer(b"".join(x), np.uint8) for x in zip(*got, strict=True))
            word = _MIDDLE[words][at]
            history = np.empty(len(at))
            history[1:] = word[:-1]
            history[first] = starts
            pair = _MIDDLE[levels][np.unique(pairs(w[at], first), return_inverse=True)[1]]
            total = np.bincount(np.repeat(np.arange(len(size)), size), _smoothed(pair, history, word, d), len(size))
            return pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(size))), pa.array(total)], names=["uid", "score"])

        for b in batches:
            for k, segment, size, w, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if segment is None:
                    if block:
                        yield done()
                    uid, block, got = k, (size, w, p), []
                else:
                    got.append((w, p))
        if block:
            yield done()

    with scratch(blocks.sparkSession):
        asks = blocks.mapInArrow(leaving_nothing(ask), "segment long, block long, w binary, p binary").select("segment", "block", F.lit(None).cast("long").alias("bits"), "w", "p")
        own = model.parts.select("segment", F.lit(None).cast("long").alias("block"), "bits", F.col("filter").alias("w"), F.lit(None).cast("binary").alias("p"))
        dealt = own.unionByName(asks).repartition("segment").sortWithinPartitions("segment", F.col("block").asc_nulls_first())
        answers = stage(dealt.mapInArrow(leaving_nothing(answer), "block long, segment long, w binary, p binary"), "lm-answers")
        answers = answers.select("block", "segment", F.lit(None).cast("binary").alias("size"), "w", "p")
        heads = blocks.select(F.col("uid").alias("block"), F.lit(None).cast("long").alias("segment"), "size", F.col("words").alias("w"), F.col("at").alias("p"))
        met = heads.unionByName(answers).repartition("block").sortWithinPartitions("block", F.col("segment").asc_nulls_first())
        return result(met.mapInArrow(leaving_nothing(scored), "uid long, score double"), "lm-scores")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    spark = docs.sparkSession
    least, words, counts = model.hot(hot_words)
    d, starts = model.denominator, model.docs
    by_broadcast = model.filter_bytes <= broadcast_bytes
    shared = spark.sparkContext.broadcast((words, counts, model.filter_arrays() if by_broadcast else None))
    segments = model.segments
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["uid", "doc_id", "n_tokens", "known", "base", "score", "rest", "size", "words", "at"]

    def run(batches):
        from pyspark import TaskContext

        hot, hot_c, arrays = shared.value
        uid = TaskContext.get().partitionId() << 36
        held, n, begin = [], 0, uid

        def block(doc_id, rest):
            """A row that has the block of the held texts, whose first is ``begin``, and nothing of a document."""
            cols = [pa.array([begin]), pa.nulls(1, doc_id), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest))]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([x], pa.binary()) for x in _block(held))], names=names)

        for b in batches:
            texts = [tokens(x.as_py()) for x in b.column(1)]
            size = np.array([len(t) for t in texts], np.int64)
            edge = np.concatenate(([0], np.cumsum(size)))[:-1]
            t = np.concatenate(texts) if texts else np.empty(0, np.uint64)
            doc = np.repeat(np.arange(len(texts)), size)
            u, inv = np.unique(t, return_inverse=True)
            c = _exact(u, hot, hot_c)
            known, base = (c > 0)[inv], np.log10((np.maximum(c, 0) + 0.1) / d)[inv]
            cold = (c < 0)[inv]
            base[cold] = 0.0
            n_known, base_sum = np.bincount(doc, known, len(texts)).astype(np.int64), np.bincount(doc, base, len(texts))
            # the other words of each document, with how often each occurs
            key, m = np.unique(np.stack((doc[cold].astype(np.uint64), t[cold])), axis=1, return_counts=True) if cold.any() else (np.empty((2, 0), np.uint64), np.empty(0, np.int64))
            offsets = np.searchsorted(key[0], np.arange(len(texts) + 1).astype(np.uint64)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(key[1].view(np.int64)), pa.array(m.astype(np.int64))], names=["word", "m"]))
            if arrays is not None:
                bits, start, data = arrays
                look = lambda h: probe(h, bits[s := segment_of(h, segments)], start[s], data)
                est = _MIDDLE[look(u)]
                pu, pinv = np.unique(pairs(t, edge), return_inverse=True)
                pc = _MIDDLE[look(pu)][pinv]
                w = est[inv]
                history = np.empty(len(t))
                history[1:] = w[:-1]
                history[edge] = starts
                total = np.bincount(doc, _smoothed(pc, history, w, d), len(texts))
            else:
                total = np.zeros(len(texts))
            cols = [pa.array(uid + np.arange(len(texts))), b.column(0), pa.array(size), pa.array(n_known), pa.array(base_sum), pa.array(total), rest]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(texts), pa.binary())] * 3], names=names)
            for k, x in enumerate(texts if arrays is None else []):
                begin = begin if held else uid + k
                held.append(x)
                n += len(x)
                if n >= FLUSH_TOKENS:
                    yield block(b.column(0).type, rest.type)
                    held, n = [], 0
            uid += len(texts)
        if held:
            yield block(b.column(0).type, rest.type)

    schema = f"uid long, doc_id {kind}, n_tokens long, known long, base double, score double, rest array<struct<word:long,m:long>>, size binary, words binary, at binary"
    every = stage(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(leaving_nothing(run, _forget), schema), "lm-first")
    shared.unpersist()
    first, blocks = every.filter("n_tokens IS NOT NULL").drop("size", "words", "at"), every.filter("n_tokens IS NULL").select("uid", "size", "words", "at")
    rest = first.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.m")
    met = rest.join(model.vocabulary.filter(F.col("c") < least), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known2"), F.sum(F.col("m") * F.log10((F.col("c") + 0.1) / F.lit(d))).alias("base2"))
    out = first.drop("rest").join(more, "uid", "left")
    if not by_broadcast:
        out = out.drop("score").join(_scores_by_owners(blocks, model), "uid")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = Model(docs.filter(~held_out("doc_id", 10, 0)))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
