"""Language identification by mixture inference over character n-grams.

Training counts the character n-grams (1 to ``N`` letters, with word boundaries) of every labelled training text per
language, hashed into ``BUCKETS`` columns; the model is one smoothed log-likelihood row for each language, so its size
is languages x BUCKETS, checked against ``MODEL_BYTES`` before it is broadcast.

Prediction takes a text as a mixture of languages: each word is drawn from one of them, with the likelihood of its
n-grams. Expectation-maximisation estimates the proportions, of each text until its own move less than ``MOVE``, so that a
result doesn't depend on what else is in a batch. The language set starts with all languages. Languages are taken out in
the order of their proportions, the smallest first (a linear number of fits, where trying every removal takes a quadratic
one), as long as the penalised likelihood log L - (languages / 2) log(words) doesn't fall. The language of the greatest
proportion is predicted, the proportion is the score.

Nulls: a text that is null, empty or without a letter is ``und`` with score 0. Rows without a label aren't learnt from.
Repeated rows count each time. If nothing is learnt, every text is ``und``. Empty tables give empty results. Other
columns are ignored; label, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, leaving_nothing, result, scratch, stage, table

N, BUCKETS, SMOOTH = 3, 1 << 15, 0.5
MODEL_BYTES = 256 << 20
MAX_WORD, ROUNDS, MOVE, BATCH_TEXTS = 64, 20, 1e-3, 200
_words = re.compile(r"[^\W\d_]+")
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def grams(words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of all words, where each word's n-grams begin); a word's two ends count as letters."""
    c = np.frombuffer("".join([f"\x02{w}\x03" for w in words_]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = c == 3
    h, rows, ok = np.zeros(len(c), np.uint64), [], np.ones(len(c), bool)
    for n in range(N):
        if n:
            ok = ok[:-1] & ~end[n - 1 : len(c) - 1]
        h = (h[: len(c) - n] + c[n:] + _U(n + 1)) * _MUL
        h = h ^ (h >> _U(29))
        rows.append(np.where(ok, (h % _U(BUCKETS)).astype(np.int64), -1))
    m = np.full((len(c), N), -1, np.int64)
    for n, r in enumerate(rows):
        m[: len(r), n] = r
    first = np.flatnonzero(c == 2)
    held = m.ravel() >= 0
    return m.ravel()[held], np.concatenate(([0], np.cumsum(held)))[first * N]


def words(text: str | None) -> list[str]:
    """Runs of letters, lower case; a run longer than MAX_WORD comes in parts, so that none is dropped."""
    found = _words.findall((text or "").lower())
    if not "".join(found).isalpha() and found:  # word characters that are numbers, like fractions and circled digits, are no letters
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    if any(len(w) > MAX_WORD for w in found):
        found = [w[k : k + MAX_WORD] for w in found for k in range(0, len(w), MAX_WORD)]
    return found


def counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs``; each task sends one row for each language and bucket at most."""

    def run(batches):
        seen: dict[str, Counter] = {}
        total: dict[str, np.ndarray] = {}

        def flush(lang):
            own = seen.pop(lang, None)
            if own:
                g, first = grams(list(own))
                times = np.diff(np.append(first, len(g)))
                weights = np.repeat(np.fromiter(own.values(), float, len(own)), times)
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(g, weights, BUCKETS).astype(np.int64)

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lang, Counter())
                own.update(words(text))
                if len(own) > 100_000:
                    flush(lang)
        for lang in list(seen):
            flush(lang)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    part = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(leaving_nothing(run), "lang string, bucket long, n long")
    return part.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log-likelihood of each bucket in each of them."""
    with scratch(docs.sparkSession):
        return _trained(docs, text_col, lang_col)


def _trained(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    learnt = stage(counts(docs.filter(F.col(lang_col).isNotNull()), text_col, lang_col), "language-counts")
    per_lang = learnt.groupBy("lang").agg(F.sum("n").alias("n")).count()
    if per_lang * BUCKETS * 8 > MODEL_BYTES:
        raise ValueError(f"{per_lang} languages x {BUCKETS} buckets exceed the model's bound of {MODEL_BYTES} bytes")
    got = learnt.toPandas()  # languages x BUCKETS rows at most
    langs = sorted(got["lang"].unique())
    n = np.zeros((len(langs), BUCKETS))
    n[got["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"]
    return langs, np.log((n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)) if langs else n


def mixtures(like: np.ndarray, weight: np.ndarray, first: np.ndarray, p: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many texts at once: proportions p (texts x languages) and log-likelihoods.

    like: the words of all texts x languages, each row's best is 1; text t has the words from first[t] on. Languages with
    proportion 0 stay out.
    """
    size = np.diff(np.append(first, len(like)))
    text, total = np.repeat(np.arange(len(first)), size), np.add.reduceat(weight, first)[:, None]
    p, going = p.copy(), np.arange(len(first))
    some, many, begin, of = like, weight, first, text  # of the texts that still move
    for _ in range(rounds):
        post = some * p[of]
        post *= (many / post.sum(axis=1))[:, None]
        new = np.add.reduceat(post, begin, axis=0) / total[going]
        moves = np.abs(new - p[going]).max(axis=1) >= MOVE
        p[going] = new
        if not moves.any():
            break
        if not moves.all():
            rows = np.repeat(moves, size[going])
            going, some, many, of = going[moves], some[rows], many[rows], of[rows]
            begin = np.concatenate(([0], np.cumsum(size[going])))[:-1]
    return p, np.add.reduceat(weight * np.log((like * p[text]).sum(axis=1)), first)


def infer(loglike: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of each text's language set of greatest penalised likelihood (texts x languages, 0 outside the set)."""
    like = np.exp(np.maximum(loglike - loglike.max(axis=1, keepdims=True), -60.0))
    n, k = len(first), like.shape[1]
    fine = np.log(np.maximum(2.0, np.add.reduceat(weight, first))) / 2
    p, value = mixtures(like, weight, first, np.full((n, k), 1 / k))
    best, value = p.copy(), value - k * fine
    open_, size = np.arange(n), np.diff(np.append(first, len(like)))
    for langs in range(k - 1, 0, -1):
        if not len(open_):
            break
        # the weakest language of each text goes: its removal costs least
        q = best[open_]
        weakest = np.where(q > 0, q, np.inf).argmin(axis=1)
        q[np.arange(len(q)), weakest] = 0
        q = np.where(q > 0, q + 1e-3, 0)
        some = q.sum(axis=1) > 0
        open_, q = open_[some], q[some]
        if not len(open_):
            break
        rows = np.repeat(first[open_] - np.concatenate(([0], np.cumsum(size[open_])))[:-1], size[open_]) + np.arange(size[open_].sum())
        begin = np.concatenate(([0], np.cumsum(size[open_])))[:-1]
        q, v = mixtures(like[rows], weight[rows], begin, q / q.sum(axis=1, keepdims=True))
        v -= langs * fine[open_]
        better = v >= value[open_]
        best[open_[better]], value[open_[better]] = q[better], v[better]
        open_ = open_[better]
    return best


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, lang_pred, score, proportions (map of the chosen languages), and the columns ``keep``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    places = {text_col: 1} | {c: k for k, c in enumerate((c for c in keep if c != text_col), 2)}

    def run(batches):
        langs, table_ = shared.value
        table_ = np.ascontiguousarray(table_.T)
        for b in batches:
            texts = b.column(1).to_pylist()
            bags = [Counter(words(t)) if langs and t else None for t in texts]
            at = [k for k, bag in enumerate(bags) if bag]
            pred, score, shares = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if at:
                known = {w: k for k, w in enumerate(dict.fromkeys(w for k in at for w in bags[k]))}
                g, begin = grams(list(known))
                rows = np.add.reduceat(table_[g], begin, axis=0)
                size = np.array([len(bags[k]) for k in at])
                which = np.fromiter((known[w] for k in at for w in bags[k]), np.int64, size.sum())
                weight = np.fromiter((n for k in at for n in bags[k].values()), float, size.sum())
                p = infer(rows[which], weight, np.concatenate(([0], np.cumsum(size)))[:-1])
                for k, own in zip(at, p, strict=True):
                    top = int(own.argmax())
                    pred[k], score[k] = langs[top], min(1.0, float(own[top]))
                    shares[k] = [(langs[j], float(own[j])) for j in np.flatnonzero(own)]
            cols = [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64())), *(b.column(places[c]) for c in keep)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "proportions", *keep])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {kinds[id_col]}, lang_pred string, score double, proportions map<string,double>" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(c for c in keep if c != text_col)).mapInArrow(leaving_nothing(run), schema)
    with scratch(spark):
        return result(found, "languages", BATCH_TEXTS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out("doc_id", 3, 1)))
    return identify(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
