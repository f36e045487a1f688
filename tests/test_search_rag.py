import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.operators import evaluate, index, plugins, rag, search
from docquarry.plans import jobs
from docquarry.plans.settings import SearchSettings
from docquarry.streaming import upsert


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, score double")


def test_bm25_equals_the_formula(spark):
    docs = {"a": "x y y z", "b": "x x", "c": "", "d": "Q x. w"}
    df = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    q = spark.createDataFrame([(1, "x y nothing"), (2, "")], "query_id long, query string")
    toks = {k: [w.strip(".").lower() for w in t.split()] for k, t in docs.items()}
    avg, n = sum(map(len, toks.values())) / 4, 4
    want = {}
    for k, t in toks.items():
        s = 0
        for term in ("x", "y"):
            tf, d = Counter(t)[term], sum(term in u for u in toks.values())
            s += math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want[k] = s
    got = {r["chunk_id"]: r["score"] for r in search.bm25_search(q, df).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert [r["chunk_id"] for r in search.bm25_search(q.withColumn("query", F.lit("x y")), df, mode="and").filter("query_id = 1").collect()] == ["a"]


def test_rrf_ties_and_hybrid(spark):
    a = ranked(spark, [(1, "p", 1, 9.0), (1, "q", 2, 8.0)])
    b = ranked(spark, [(1, "r", 1, 0.9), (1, "q", 2, 0.8)])
    got = [(r["chunk_id"], r["fused"]) for r in search.rrf_fuse(a, b).orderBy("rank").collect()]
    assert got == [("q", round(2 / 62, 9)), ("p", round(1 / 61, 9)), ("r", round(1 / 61, 9))]
    pay = spark.createDataFrame([("q", "t\nu", "s")], "chunk_id string, text string, section string")
    rows = {r["chunk_id"]: r for r in search.hybrid(a, b, pay).collect()}
    assert rows["q"]["text"] == "t u" and rows["p"]["text"] is None and rows["p"]["dense_score"] == 0 and rows["q"]["bm25_score"] == 8
    assert [r["chunk_id"] for r in search.rrf_fuse(a, b.limit(0)).orderBy("rank").collect()] == ["p", "q"]


def test_dense_blocks(spark):
    v = spark.createDataFrame([(k, [float(math.cos(k)), float(math.sin(k))]) for k in range(40)], "chunk_id long, vec array<float>")
    q = v.select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"))
    many = q.crossJoin(spark.range(10)).withColumn("query_id", F.col("query_id") * 10 + F.col("id")).drop("id")
    got = search.dense_search(many, v, 1).collect()
    assert len(got) == 400 and all(r["score"] == 1.0 for r in got)


def test_dense_ties_and_parts(spark, monkeypatch):
    """Ties go to the smaller id, whatever the batches, the blocks of queries and the kind of id; zero vectors score 0."""
    monkeypatch.setattr(search, "QUERY_BYTES", 64)
    rows = [(f"c{k:03d}", [float(k % 3), 1.0]) for k in range(60)] + [("zero", [0.0, 0.0]), ("none", None)]
    v = spark.createDataFrame(rows, "chunk_id string, vec array<double>").repartition(7)
    q = spark.createDataFrame([(n, [x, 1.0]) for n, x in enumerate((0.0, 1.0, 2.0, -1.0, 5.0, 0.5, 3.0))], "query_id int, query_vec array<double>")
    got = {}
    for r in search.dense_search(q, v, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for n, u in ((r["query_id"], r["query_vec"]) for r in q.collect()):
        cos = lambda x, u=u: round((x[0] * u[0] + x[1] * u[1]) / ((math.hypot(*x) or 1) * math.hypot(*u)), 6) + 0.0
        want = sorted(((i, cos(x)) for i, x in rows if x), key=lambda t: (-t[1], t[0]))[:5]
        assert got[n] == want


def test_phrases(spark):
    docs = spark.createDataFrame([("a", "the dog bites the man; the dog bites"), ("b", "man bites the dog"), ("c", "dog, BITES!"), ("d", None)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "dog bites"), (2, "the the"), (3, ""), (4, "man bites the dog")], "query_id int, query string")
    got = [(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in search.phrase_search(q, docs).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 2.0, 1), (1, "c", 1.0, 2), (4, "b", 1.0, 1)]


def test_bm25_beyond_the_terms_in_place(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} and w{k % 3}") for k in range(60)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "w1 w2"), (2, "and w4")], "query_id int, query string")
    docs = docs.withColumn("section", F.concat(F.lit("w"), (F.col("chunk_id") % 4).cast("string")))
    how = [{}, {"mode": "and"}, {"fields": ("text", "section")}, {"fields": ("text", "section"), "mode": "and"}]
    few = [sorted(search.bm25_search(q, docs, 10, **h).collect()) for h in how]
    monkeypatch.setattr(search, "ASKED", 0)
    monkeypatch.setattr(search, "WEIGHTS", 0)
    assert few == [sorted(search.bm25_search(q, docs, 10, **h).collect()) for h in how] and all(few)


def test_context_skips_and_continues(spark):
    rows = [(1, f"c{k}", k, "x" * n) for k, n in enumerate((400, 7000, 300, 0), 1)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, text string")
    (got,) = rag.pack_context(df, 1800).collect()
    assert [b["chunk_id"] for b in got["blocks"]] == ["c1", "c3", "c4"]
    text = rag.pack_context(df.filter("rank > 2"), 1800).select(rag.render_context("blocks")).first()[0]
    assert text == "[c3] None — None\n" + "x" * 300 + "\n\n---\n[c4] None — None\n\n"
    p = spark.range(1).select(rag.prompt(F.lit("why $x$?"), F.lit("ctx")).alias("p")).first()["p"]
    assert p["system"].endswith("alter math notation.") and p["user"].startswith("QUESTION:\n    why $x$?\n\n    CONTEXT:\n    ctx")


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, chunk_id string")
    got = ranked(spark, [(1, "a", 1, 0.0), (2, "x", 1, 0.0), (2, "y", 2, 0.0), (2, "b", 3, 0.0)])
    r = evaluate.retrieval_quality(evaluate.matches(gold, got)).first()
    assert (r["queries"], r["hit_rate"], r["mrr"]) == (3, pytest.approx(2 / 3), pytest.approx((1 + 1 / 3) / 3))
    assert evaluate.retrieval_quality(evaluate.matches(gold.limit(0), got)).first()["mrr"] is None
    j = spark.createDataFrame([(json.dumps({"overall_score": 80, "correctness": 90}),), ("bad",)], "judgement string")
    assert jobs.evaluate_answers(j).first()["overall_score"] == 80
    e = spark.createDataFrame([("q", None, "OK"), ("", None, "OK"), ("r", "s", "update"), ("t", None, "fail")], "query_v1 string, query_v2 string, evaluation string")
    assert sorted(r["query_v2"] for r in evaluate.keep_queries(e).collect()) == ["q", "s"]
    assert evaluate.sample(spark.range(5), 10, "id").count() == 5


def test_end_to_end(spark, tmp_path):
    md = spark.createDataFrame([("/d/a.md", "# Spectral\nThe eigenvalue of a laplacian.\n\n# Other\nNothing here."), ("/d/n.md", None)], "file string, text string")
    txt = spark.createDataFrame([("/d/b.txt", "Abstract\n\nPlain words about spectral theory and stability."), ("/d/e.txt", "")], "file string, text string")
    out = jobs.run_chunking(md, txt, str(tmp_path / "chunks"))
    assert out["md"].count() == 2 and out["txt"].count() == 1 and out["md_quarantine"].count() == 1
    services = []
    for source in ("md", "txt"):
        path = str(tmp_path / source)
        counts = jobs.run_indexing(out[source], path, source, plugins.hashing_embedder(32), 32)
        assert counts["bm25"].first()["indexed"] == out[source].count()
        services.append(jobs.SearchService(spark, SearchSettings.of(source, path, expected_dim=32), plugins.hashing_embedder(32)))
    with pytest.raises(ValueError):
        jobs.SearchService(spark, SearchSettings.of("md", str(tmp_path / "md"), expected_dim=384))
    with pytest.raises(ValueError):
        SearchSettings.of("pdf", "x")
    q = spark.createDataFrame([(1, "eigenvalue of a laplacian")], "query_id long, query string")
    found = jobs.retrieve(q, services).orderBy("rank").collect()
    assert found[0]["chunk_id"].startswith("a::L1") and len(found) == 3
    (a,) = jobs.answer(q, services).collect()
    assert a["answer"].startswith("[a::L1") and "Preserve LaTeX" in a["prompt"]["system"]
    gold = q.withColumn("chunk_id", F.lit(found[0]["chunk_id"]))
    assert jobs.evaluate_retrieval(gold, services).first()["mrr"] == 1.0
    assert jobs.query_prompts(out["txt"], ["abstract"], 5).count() == 1


def test_vectors_and_dims(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", " ")], "chunk_id string, text string")
    p = index.points(df, index.VectorSpec("c", 8, plugins.hashing_embedder(8)))
    assert p.count() == 1 and index.collection_dim(p) == 8
    index.check_dims("c", 8, 8, None)
    with pytest.raises(ValueError):
        index.check_dims("c", 8, 9)


def chunks_of(store, *cols):
    return {r["chunk_id"]: r["text"] for r in store.read().collect()}


def test_upsert_stream(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    schema = "chunk_id string, text string, n int"
    store = upsert.Store(spark, str(tmp_path / "idx"))

    def put(name, *rows, checkpoint=ck, order="n"):
        (src / name).write_text("".join(json.dumps(dict(zip(("chunk_id", "text", "n"), r, strict=True))) + "\n" for r in rows))
        upsert.upsert_stream(spark, str(src), schema, store, checkpoint, order=order).awaitTermination()
        return chunks_of(store)

    assert put("1.jsonl", ("a", "one", 1), ("b", "two", 2), ("a", "uno", 3), ("c", " ", 4)) == {"a": "uno", "b": "two"}
    assert put("2.jsonl", ("b", "dos", 1), ("d", "new", 2)) == {"a": "uno", "b": "dos", "d": "new"}
    batch = spark.createDataFrame([("a", "again", 9)], schema)
    assert not store.merge(batch, ck, 1)  # a replayed batch
    assert chunks_of(store)["a"] == "uno"
    # a stream with a checkpoint of its own starts at epoch 0 and loses nothing
    (src / "1.jsonl").unlink(), (src / "2.jsonl").unlink()
    assert put("3.jsonl", ("e", "first", 1), ("e", "last", 1), checkpoint=str(tmp_path / "ck2"), order=None) == {"a": "uno", "b": "dos", "d": "new", "e": "last"}
    assert store.merge(batch, "third", 0) and chunks_of(store)["a"] == "again"


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "s"), buckets=8)
    store.merge(spark.range(100).selectExpr("cast(id AS string) AS chunk_id", "'x' AS text"), "w", 0)
    store.merge(spark.createDataFrame([("5", "y")], "chunk_id string, text string"), "w", 1)
    m = store.manifest()
    assert sorted(m["at"]["rows"].values()) == [1] * 7 + [2] and store.read().count() == 100 and chunks_of(store)["5"] == "y"
    store.merge(spark.createDataFrame([("6", "z", 1)], "chunk_id string, text string, more int"), "w", 2)
    assert store.read().filter("more = 1").count() == 1 and store.read().count() == 100


def test_search_sees_upserts(spark, tmp_path):
    """Postings, frequencies and statistics after upserts equal those of an index built anew."""
    docs = [(f"d{k}", f"w{k % 5} w{k % 3} common", f"s{k % 2}") for k in range(40)]
    newer = [(f"d{k}", f"w{k % 4} fresh fresh", "s9") for k in range(0, 40, 7)] + [("e1", "fresh w1", "s1")]
    schema = "chunk_id string, text string, section string"
    store = index.lexical_store(spark, str(tmp_path / "a"), buckets=4)
    store.merge(spark.createDataFrame(docs, schema), "w", 0)
    store.merge(spark.createDataFrame(newer, schema), "w", 1)
    now = spark.createDataFrame(list(({d[0]: d for d in docs} | {d[0]: d for d in newer}).values()), schema)
    q = spark.createDataFrame([(1, "fresh w1"), (2, "common s9")], "query_id long, query string")
    opened = index.open_lexical(spark, str(tmp_path / "a"))
    assert opened["docs"].count() == 41
    found = search.bm25_scores(q, opened["postings"], opened["stats"]).collect()
    assert sorted(found) == sorted(search.bm25_scores(q, index.postings(now), index.field_stats(now)).collect()) and found
    points = upsert.Store(spark, str(tmp_path / "p"))
    embed = upsert.with_point_ids(plugins.hashing_embedder(8))
    points.merge(embed(spark.createDataFrame(docs, schema)), "w", 0)
    points.merge(embed(spark.createDataFrame(newer, schema)), "w", 1)
    vectors = index.open_points(spark, str(tmp_path / "p"))
    asked = q.select("query_id", plugins.hashing_embedder(8)(F.col("query")).alias("query_vec"))
    want = search.dense_search(asked, embed(now), 5).collect()
    assert sorted(search.dense_search(asked, vectors, 5).collect()) == sorted(want)
