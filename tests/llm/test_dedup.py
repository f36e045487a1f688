import hashlib
import itertools
import random
import re

import pytest

from docquarry.llm import exact_dedup, near_dedup
from docquarry.llm.common import connected_components


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check_exact(df, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = exact_dedup.exact_dedup(df, **how).collect()
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        least = min((i for i in ids if i is not None), default=None)
        assert r["group_size"] == len(ids) and r["keep_id"] == least
        assert not r["kept"] or r["doc_id"] == least
    for h, ids in by_hash.items():
        assert sum(r["kept"] for r in got if r["text_sha256"] == h) == 1


def test_exact(documents):
    check_exact(documents)


def test_exact_odd(odd, none):
    check_exact(odd)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.distinct_documents(odd).collect()
    assert len(kept) == len({norm(r["text"]) for r in odd.collect()})
    assert {c for c in odd.columns} == {*kept[0].asDict()}


def test_collisions_and_splits(documents):
    """Three bits of hash: every chain is long, texts decide; a capacity of one makes the directory double to its end."""
    check_exact(documents, key_bits=3, bucket_capacity=1)


def test_directory(documents):
    keys = documents.selectExpr("xxhash64(doc_id) AS key")
    slots, depth = exact_dedup.directory(keys, 10)
    rows = slots.collect()
    assert len({r["address"] for r in rows}) == len(rows) <= 2**depth
    n = {}
    for k in keys.collect():
        n[(k["key"] % 2**64) >> (64 - depth)] = n.get((k["key"] % 2**64) >> (64 - depth), 0) + 1
    bucket = {r["address"]: r["bucket"] for r in rows}
    held = {}
    for a, k in n.items():
        held[bucket[a]] = held.get(bucket[a], 0) + k
    assert max(held.values()) <= 10


def brute_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        w = min(width, len(words))
        sets.setdefault(i, set()).update(tuple(words[k : k + w]) for k in range(len(words) - w + 1) if w)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if i is not None), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in sets}


def check_near(df, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = brute_near(rows, how.get("width", 5), 80)
    got = near_dedup.near_duplicates(df, **how).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]][1])


def test_near(documents):
    check_near(documents, width=2)
    check_near(documents, width=5)


def test_near_odd(odd, none):
    check_near(odd, width=2)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_chain(spark):
    """A chain of edits: neighbours link, ends don't; and texts that share much and link with nothing."""
    words = [f"w{k}" for k in range(200)]
    rows = [(10 + k, " ".join(words[3 * k :] + [f"v{j}" for j in range(3 * k)])) for k in range(5)]
    rows += [(100 + k, " ".join(words[:120] + [f"u{k}x{j}" for j in range(40)])) for k in range(4)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), width=2)


@pytest.mark.parametrize("block", [512, 24])
def test_near_copies_around_the_threshold(spark, monkeypatch, block):
    """Three hundred variants of one text whose pairs lie on both sides of 0.8, in one block and in many that meet."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(240)]
    rows = []
    for k in range(300):
        own = list(base)
        for at in rng.sample(range(240), rng.choice((9, 12, 14))):
            own[at] = f"x{k}y{at}"
        rows.append((500 - k, " ".join(own)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), width=2)


def test_near_ids_that_repeat(spark):
    """Rows of one id with different texts are documents of their own; the component is the smallest id reached."""
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a + ["z"])), (3, " ".join(b + ["z"])), (9, "alone here")]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(5, 56, 5, True), (5, 56, 3, False), (7, 57, 5, False), (3, 57, 3, True), (9, 1, 9, True)])


def test_bayes_bounds():
    assert near_dedup.least_agreement(32, 0.8) < 0.8 * 32
    assert near_dedup.least_agreement(128, 0.8) > 64


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (100, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {r["node"]: r["component"] for r in connected_components(df.repartition(7), task_links=0).collect()} | {7: 0}
    assert connected_components(df.limit(0)).count() == 0
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[101] == got[50] == 50 and all(got[200 + k] == 200 for k in range(30))
