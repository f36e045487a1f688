import math
import itertools
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import language_id, licenses, lm_scoring, pii
from docquarry.llm.common import held_out


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def check_lm(df, **how):
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in df.select("doc_id", "text").collect()]
    c = Counter(w for i, ws in rows if crc(i) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    model = lm_scoring.Model(df.filter(~held_out("doc_id", 10, 0)))
    got = lm_scoring.score(df, model, **how).collect()
    assert (model.n, model.v) == (n, v) and len(got) == len(rows)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in rows)
    assert [x[:3] for x in want] == sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"]) for r in got)
    assert np.allclose(sorted(x[3] for x in want), sorted(r["base_score"] for r in got))
    return {(r["doc_id"], r["n_tokens"]): r for r in got}


def test_lm(documents):
    got = check_lm(documents)
    held = [r for r in got.values() if crc(r["doc_id"]) % 10 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    few = check_lm(documents, hot_words=40)  # most words meet the vocabulary in the join
    far = check_lm(documents, broadcast_bytes=0, hot_words=40)  # and the filter stays with its owners
    for k, r in few.items():
        assert far[k]["score"] == pytest.approx(r["score"], abs=1e-6) and got[k]["score"] == pytest.approx(r["score"], abs=1e-6)


def test_lm_score_by_brute_force(documents):
    """Without false positives the score is the smoothed pair model over quantised counts; the filter's are rare and small."""
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b"\n"]) for r in documents.collect()]
    train = [ws for i, ws in rows if crc(i) % 10]
    one, two = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([b"\r", *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)
    quantised = lambda c: lm_scoring._MIDDLE[lm_scoring.level(np.array([c]))[0]] if c else 0.0
    model = lm_scoring.Model(documents.filter(~held_out("doc_id", 10, 0)))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(documents, model).collect()}
    gaps = []
    for i, ws in rows:
        total = 0.0
        for u, w in zip([b"\r", *ws], ws, strict=False):
            history = float(len(train)) if u == b"\r" else quantised(one[u])
            word = quantised(one[w])
            pair = min(quantised(two[u, w]), history, word)
            total += math.log10((pair + lm_scoring.MU * (word + 0.1) / (n + 0.1 * (v + 1))) / (history + lm_scoring.MU))
        gaps.append((got[i] - total) / len(ws))
    assert np.median(np.abs(gaps)) < 0.01 and max(map(abs, gaps)) < 0.25


def test_lm_owners(documents, odd, none, spark, monkeypatch):
    """With the filter at its owners less is shuffled than three times the text, and scores stay the same over many blocks and segments."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def moved():
        bus.waitUntilEmpty(30_000)
        return store.executorSummary("driver").totalShuffleWrite()

    model = lm_scoring.Model(documents.filter(~held_out("doc_id", 10, 0)))
    before = moved()
    lm_scoring.score(documents, model, broadcast_bytes=0).collect()
    assert moved() - before < 3 * sum(len((r["text"] or "").encode()) for r in documents.collect())

    scores = lambda df, model, **how: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in lm_scoring.score(df, model, **how).collect())
    monkeypatch.setattr(lm_scoring, "SEGMENT_CHARS", 5_000)
    monkeypatch.setattr(lm_scoring, "FLUSH_TOKENS", 3_000)
    few = documents.filter("doc_id < 20")
    for train, df in ((documents, documents), (few, documents), (documents.limit(0), few), (odd, odd), (odd, none)):
        model = lm_scoring.Model(train)
        assert scores(df, model) == scores(df, model, broadcast_bytes=0)
    assert lm_scoring.Model(documents).segments > 20


def test_packed_pairs():
    rng = np.random.default_rng(2)
    for n, high in ((1, 1 << 63), (1000, 1 << 63), (50_000, 1 << 58), (100_000, 1 << 62), (3, 1 << 18), (0, 1 << 63)):
        t = rng.integers(0, high, n, np.uint64)
        h = np.unique((t >> np.uint64(16) << np.uint64(16)) | np.uint64(1))
        x = lm_scoring.packed(h)
        assert (lm_scoring.unpacked(x) == h).all()
    assert len(lm_scoring.packed(np.arange(1, 1 << 30, 1 << 16, np.uint64))) < 5 * (1 << 14)


def test_lm_odd(odd, none, spark):
    check_lm(odd)
    assert lm_scoring.score(none, lm_scoring.Model(odd)).count() == 0
    got = lm_scoring.score(odd, lm_scoring.Model(none)).collect()
    assert len(got) == odd.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


def test_filter_holds_every_level():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64))
    c = rng.integers(1, 3000, len(h))
    bits, data = lm_scoring.make_segment(h, c)
    data = np.frombuffer(data, np.uint8)
    probe = lambda x: lm_scoring.probe(x, np.full(len(x), bits), np.zeros(len(x), np.int64), data)
    assert (probe(h) >= lm_scoring.level(c)).all() and (probe(h) == lm_scoring.level(c)).mean() > 0.9
    assert (probe(rng.integers(0, 1 << 63, 5000, np.uint64)) > 0).mean() < 0.05


def test_language(documents, spark):
    model = language_id.train(documents.filter(~held_out("doc_id", 3, 1)))
    got = {r["doc_id"]: r for r in language_id.identify(documents, model).collect()}
    rows = [r for r in documents.collect() if crc(r["doc_id"]) % 3 == 1 and r["lang"] and got[r["doc_id"]]["lang_pred"] != "und"]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.93
    for r in got.values():
        assert 0 <= r["score"] <= 1
    # a text half in one language, half in another, gets both
    en, de = (" ".join(r["text"] for r in documents.collect() if r["lang"] == x)[:4000] for x in ("en", "de"))
    (mixed,) = language_id.identify(spark.createDataFrame([(1, en + "\n" + de)], "doc_id long, text string"), model).collect()
    assert {"en", "de"} <= set(mixed["proportions"]) and 0.3 < mixed["score"] < 0.7


def test_language_odd(odd, none, documents):
    model = language_id.train(documents)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    letters = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    assert sorted((str(r["doc_id"]), r["lang_pred"] == "und") for r in got) == sorted((str(r["doc_id"]), not letters(r["text"])) for r in odd.collect())
    assert language_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.train(none)).collect()} == {"und"}


def test_language_letters_and_batches(documents, spark):
    """Numbers of any script are no letters; a result doesn't depend on what else is in a batch."""
    model = language_id.train(documents)
    rows = [(1, "½ ²"), (2, "Ⅷ ①"), (3, "٣ 5"), (4, "² é"), (5, "x²y")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[k] == "und" for k in range(1, 6)] == [True, True, True, False, False]
    assert language_id.words("x²y ½") == ["x", "y"]
    one, many = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(d, model).collect()) for d in (documents.coalesce(1), documents.repartition(40)))
    assert one == many


def test_mixture_by_brute_force():
    """On small texts the fitted proportions are those of greatest likelihood on a fine grid, and the set that of greatest penalised likelihood along the removals."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, k = int(rng.integers(5, 30)), 3
        like, weight = rng.normal(0, 2, (n, k)), rng.integers(1, 5, n).astype(float)
        scaled = np.exp(like - like.max(axis=1, keepdims=True))
        p, value = language_id.mixtures(scaled, weight, np.array([0]), np.full((1, k), 1 / k), rounds=500)
        grid = [np.array([a, b, 60 - a - b]) / 60 for a, b in itertools.product(range(61), repeat=2) if a + b <= 60]
        best = max(float((weight * np.log(np.maximum(scaled @ g, 1e-300))).sum()) for g in grid)
        assert value[0] >= best - 0.05
        q = language_id.infer(like, weight, np.array([0]))[0]
        kept = q > 0
        fine = math.log(max(2, weight.sum())) / 2
        own = float((weight * np.log(scaled @ q)).sum()) - kept.sum() * fine
        assert q.sum() == pytest.approx(1) and own >= value[0] - k * fine - 1e-6


SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spec_spans(text):
    out = []
    for k, (name, pattern) in enumerate(SPEC.items()):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(texts):
    tricky = [
        "a@b.c@d.e", "a@b.co%x@d.com", "@x.com", "a@b", "é.x@y.z.w-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0000001.2.3.4", "4111 1111 1111 1111", "4111-1111--1111",
        "+1 (555) 123-4567", "+1+12345678901", "+1 ((((", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "4041894974608795 17", "1.2.3", "a@b..c", "x+1@y.z +1 988 555 24850", "9" * 3000, "." * 50, "@" * 50,
    ]
    rng = np.random.default_rng(5)
    tricky += ["".join(rng.choice(list("ab1 2.@+-()49"), 60)) for _ in range(3000)]
    for t in [*tricky, *(t or "" for t in texts.values())]:
        assert pii.base_spans(t) == spec_spans(t), t


def pii_rows():
    rows = [(k, f"call tel: +1 (555) 010-{1000 + k} now the end") for k in range(50)]
    rows += [(100, "tel: 555 010 2222 is mine"), (101, "the 555 010 3333 is not"), (102, "write the +1 (555) 010-9999 down")]
    rows += [(200 + k, "the cat and the dog") for k in range(30)]
    # what is found beside "tel :" induces "wieder", which no seed stands beside
    rows += [(300 + k, f"tel: 555 020 {1000 + k} wieder") for k in range(12)] + [(400, "anruf 555 030 7777 wieder")]
    # common words before a number: the whole context tells
    rows += [(500 + k, f"you can reach me at +1 (555) 040-{1000 + k}") for k in range(9)] + [(510, "reach me at 555 040 5555"), (511, "we met at 555 050 6666 or so")]
    rows += [(600 + k, "look at me at last") for k in range(40)]
    rows += [(700, "x" * 500 + " tel: 555 060 8888"), (701, f"tel:\u00a0555 060 9999 {'y' * 300}")]
    return rows


def brute_bootstrap(rows):
    """The same by dictionaries: contexts are tuples of tokens, instances are strings."""
    tokens = lambda t: [x.lower() for x in re.findall(r"\w+|[^\w\s]", t)]
    edges, total, places = {}, Counter(), []
    for i, t in rows:
        ts = tokens(t)
        total.update(tuple(ts[k : k + n]) for n in (1, 2, 3) for k in range(len(ts) - n + 1))
        base = pii.base_spans(t)
        wide = [(s, k, e) for s, k, e in pii.wide_spans(t) if not any(s < f and b < e for b, _, f in base)]
        for (s, k, e), seed in [(x, True) for x in base] + [(x, False) for x in wide]:
            left, right = tokens(t[:s]), tokens(t[e:])
            for p in {(k, "L", tuple(left[-n:])) for n in (1, 2, 3) if len(left) >= n} | {(k, "R", tuple(right[:n])) for n in (1, 2, 3) if len(right) >= n}:
                own = edges.setdefault(p, {}).setdefault(t[s:e], [0, False])
                own[0], own[1] = own[0] + 1, own[1] or seed
                places.append((i, s, k, e, seed, p))
    trust = {(p[0], v): 1.0 for p, vs in edges.items() for v, (_, seed) in vs.items() if seed}
    sure = {}
    while True:
        new = {}
        for p, vs in edges.items():
            held = [(n, trust[p[0], v]) for v, (n, _) in vs.items() if (p[0], v) in trust]
            c = sum(n * x for n, x in held) / (total[p[2]] + 1)
            if p not in sure and len(held) >= pii.MIN_VALUES and c >= pii.SURE:
                new[p] = c
        if not new:
            return sure, {(i, s, k, e) for i, s, k, e, seed, p in places if p in sure and not seed}
        sure |= new
        given = {}
        for p, c in new.items():
            for v in edges[p]:
                given[p[0], v] = max(c, given.get((p[0], v), 0))
        trust = given | trust


@pytest.mark.parametrize("most", [pii.BROADCAST_CONTEXTS, 0])
def test_bootstrap(spark, monkeypatch, most):
    monkeypatch.setattr(pii.context_totals, "__defaults__", (most,))
    rows = pii_rows()
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sure, added = brute_bootstrap(rows)
    assert {(i, x["start"], x["kind"], x["end"]) for i, r in got.items() for x in r["spans"] if x not in r["base"]} == added
    assert [tuple(x) for x in got[100]["spans"]] == [(5, 3, 17)] and not got[100]["base"]
    assert not got[101]["spans"] and got[102]["spans"] == got[102]["base"] != [] and not got[200]["spans"]
    assert len(got[400]["spans"]) == len(got[510]["spans"]) == len(got[700]["spans"]) == len(got[701]["spans"]) == 1 and not got[511]["spans"]


def test_wide_spans():
    found = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.wide_spans(t)]
    assert found("write to jo.doe (at) example (dot) org now") == [("email", "jo.doe (at) example (dot) org")]
    assert found("or joe at home dot net") == [("email", "joe at home dot net")] and not found("be at home. No")
    assert ("ip", "fe80::1:2") in found("host fe80::1:2 up") and ("phone", "(030) 123 4567") in found("dial (030) 123 4567")
    assert not found("x" * 200_000 + "@") and len(found("1" * 100_000)) == 0


def test_pii_odd(odd, none):
    got = pii.find_pii(odd).collect()
    assert len(got) == odd.count() and pii.find_pii(none).count() == 0


def test_licenses(spark, odd, none):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("src/LICENSE", "Released under the MIT License.\nsome other words here and more words that no licence has"),
        ("src/a/b.py", "code of some kind"), ("src/a/c/d.py", "some code of many other kinds that stands above\n" + gpl + "\nand still more code of yet another kind below"), ("src/a/c/e.py", "none here"),
        ("src/a/COPYING", gpl), ("other/x.py", "code"), (None, "All rights reserved."), ("src/y.py", None), ("z.py", "licensed cattle and rights of way"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "file_id long, path string, text string")
    got = {r["file_id"]: (r["license"], r["origin"], r["license_path"]) for r in licenses.scan_licenses(df, "file_id", "path", "text").collect()}
    assert got[0] == ("MIT", "own", "src/LICENSE") and got[2] == ("GPL-3.0", "own", "src/a/c/d.py")
    assert got[1] == ("GPL-3.0", "inherited", "src/a/COPYING") and got[3] == ("GPL-3.0", "inherited", "src/a/COPYING")
    assert got[5] == (None, "none", None) and got[6][:2] == ("Proprietary", "own") and got[7] == ("MIT", "inherited", "src/LICENSE") and got[8][1] == "none"
    assert licenses.scan_licenses(odd, "doc_id", "source", "text").count() == odd.count()
    assert licenses.scan_licenses(none, "doc_id", "source", "text").count() == 0


def test_license_versions_and_full_texts():
    """Similar licences are told apart, in notices across lines and in full texts; a notice alone is no whole text."""
    found = licenses.Templates(1000, {"the": 300, "of": 300}, licenses.THRESHOLD)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            score, got, whole = found.scan(text)
            assert got == name and score >= licenses.THRESHOLD, text[:200]
            assert (whole >= licenses.WHOLE) == (text == licenses.FULL.get(name))
            words = text.split()
            split = "\n".join("# " + " ".join(words[k : k + 6]) for k in range(0, len(words), 6))
            assert found.scan(f"some other code stands above\n{split}\nand yet other code below")[1] == name
    assert {"GPL-2.0", "AGPL-3.0", "LGPL-2.1", "CC-BY-SA-4.0", "BSD-2-Clause", "ISC"} <= set(licenses.TEMPLATES)
    assert found.scan("Copyright (c) 2020 A. All rights reserved.\n" + licenses.FULL["BSD-3-Clause"])[1] == "BSD-3-Clause"
    assert found.scan("This work is licensed under the GNU General Public License, version 9.")[1] is None


def test_license_lines(documents):
    from docquarry.llm.licenses import op9_licenses

    spark = documents.sparkSession
    got = {r["doc_id"]: r for r in op9_licenses(spark, "/root/testdata/sf0.001").collect()}
    for r in documents.collect():
        has = re.search(r"(?i)licensed under|MIT License|All rights reserved", r["text"] or "")
        assert (got[r["doc_id"]]["origin"] == "own") == bool(has), r["text"][-200:]
