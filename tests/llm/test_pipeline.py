import re

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages(spark, documents, tmp_path):
    docs, before = documents, {r["doc_id"]: r for r in documents.collect()}
    for k, (name, f) in enumerate(p.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        assert rows
        if k < len(p.STAGES) - 1:
            assert sorted(docs.columns) == COLUMNS
        if name == "language ID":
            assert {r["doc_id"] for r in rows} == {i for i, r in before.items() if re.search(r"[^\W\d_]", r["text"] or "")}
        if name == "exact dedup":
            assert len({norm(r["text"]) for r in rows}) == len(rows)
            first = {}
            for r in sorted(before.values(), key=lambda r: r["doc_id"]):
                first.setdefault(norm(r["text"]), r["doc_id"])
            assert all(first[norm(r["text"])] == r["doc_id"] for r in rows)
        before = {r["doc_id"]: r for r in rows}


def test_odd_and_empty(spark, odd, none, tmp_path):
    for which, docs in (("odd", odd), ("none", none)):
        for k, (_, f) in enumerate(p.STAGES):
            at = str(tmp_path / f"{which}{k}")
            f(spark, docs, SF).write.parquet(at)
            docs = spark.read.parquet(at)
        assert (docs.count() > 0) == (which == "odd")


def test_near_drop_moves_no_text(spark, documents, monkeypatch):
    """What goes is broadcast whatever Spark's own threshold; by either join the same rows stay, an id that repeats with all its rows."""
    one, two = ([f"{x}{k}" for k in range(60)] for x in "ab")
    more = [(-3, " ".join(one)), (-2, " ".join([*one, "more"])), (-1, " ".join([*one, "else"])), (-1, " ".join(two)), (None, " ".join(one)), (None, None), (-9, None)]
    more = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = documents.select(*p.COLUMNS).unionByName(more)
    kept = {r["doc_id"] for r in p.near_dedup.near_duplicates(docs).collect() if r["kept"]}
    want = sorted(str(r) for r in docs.collect() if r["doc_id"] in kept)
    assert 0 < len(want) < docs.count() and {-3, -1, -9, None} <= kept and -2 not in kept
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        near, plans = [], []
        for most in (p.near_dedup.BROADCAST_IDS, 0):
            monkeypatch.setattr(p.near_dedup, "BROADCAST_IDS", most)
            near.append(p.drop_near(spark, docs, SF))
            plans.append(near[-1]._jdf.queryExecution().executedPlan().toString())
        assert "Exchange hashpartitioning" not in plans[0] and "Exchange hashpartitioning" in plans[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(sorted(map(str, x.collect())) == want for x in near)
