"""Queries over literal rows, for what the driver's tables hold no case of; their SQL states the expected rows, derived by hand.

Also round trips of the driver's tables through files, indexes and upserts, whose SQL is the table itself.
"""

from __future__ import annotations

import gzip
import io
import tarfile

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk_md, chunk_txt, evaluate, index, latex, search
from ..sources import archives, catalogue, jsonl, sinks
from ..sources.layout import work_dir
from ..streaming import upsert
from . import jobs, settings
from .queries import _BM25_SQL, _query, _questions, _t


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def _rows(columns: str, *rows: tuple) -> str:
    """SQL that gives these rows; an integer column is an INTEGER unless its name ends in a colon and a type."""
    names = [c.partition(":") for c in columns.split()]
    cast = [f'"{n}"::{t}' + f' AS "{n}"' if t else f'"{n}"' for n, _, t in names]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT {', '.join(cast)} FROM (VALUES {values}) AS v({', '.join(chr(34) + n + chr(34) for n, _, _ in names)})"


def _numbered(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "n int, x string")


# LaTeX

@_query(_rows(
    "n x", (0, "ab"), (1, "a  d"), (2, "keep \\begin{figure} open"), (3, "x\\begin{equation}1\\end{equation}y"), (4, "pq"), (5, "a  b"),
))
def tex_clean(spark, sf_dir):
    rows = (
        "a\\begin{figure}[h]x\\begin{figure}y\\end{figure}z\\end{figure}b", "a \\begin{table*}b\\end{table*} d", "keep \\begin{figure} open",
        "x\\begin{equation}1\\end{equation}y", "p\\begin{FIGURE}t\\end{figure}q", "a \\includegraphics[width=1]{f.png} b",
    )
    return _numbered(spark, *rows).select("n", latex.clean("x").alias("x"))


def _tree(spark):
    main = "\\documentclass{a}\n\\begin{document}\n\\input{sec/one} % gone\n\\include{two}\\input{sec/one}\n100\\% \\input{none}\\end{document}"
    files = [("p", "main.tex", main), ("p", "sec/one.tex", "ONE \\input{deep}"), ("p", "sec/deep.tex", "DEEP \\input{../main}"), ("p", "two.tex", "TWO"), ("p", "alt.tex", "\\title{x}")]
    files += [("q", "b.tex", "B % c"), ("q", "a.tex", "A"), ("r", "z.tex", "\\documentclass{a}"), ("r", "a.tex", "\\documentclass{b}")]
    return spark.createDataFrame(files, "paper string, path string, text string")


@_query(_rows("paper path score", ("p", "main.tex", 6), ("r", "z.tex", 2)))
def tex_main_file(spark, sf_dir):
    return latex.main_files(_tree(spark))


@_query(_rows("paper text", ("p", "\\documentclass{a}\n\\begin{document}\nONE DEEP  \nTWO\n100\\% \\end{document}"), ("q", "A\n\nB "), ("r", "\\documentclass{a}")))
def tex_includes(spark, sf_dir):
    return latex.combine(_tree(spark))


# Archives

def _tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in (("a.tex", b"A"), ("d/b.txt", b"\xe9t\xe9"), ("../out.tex", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


@_query(_rows(
    "paper path text kind", ("1", "a.tex", "A", "tar"), ("1", "d/b.txt", "été", "tar"), ("2", "x.tex", "zipped", "gzip"), ("3", "3.tex", "plain text", "plain"),
))
def archive_members(spark, sf_dir):
    zipped = gzip.compress(b"zipped", mtime=0)
    rows = [("1", _tar(), None), ("2", zipped, 'attachment; filename="x.tex.gz"'), ("3", b"plain text", None), ("4", b"\x00\x01", None), ("5", zipped[:12], None), ("6", None, None)]
    return archives.expand(spark.createDataFrame(rows, "paper string, content binary, header string"), header_col="header")


# Text functions

@_query(_rows(
    "n chunk_type", (0, "empty"), (1, "references_header"), (2, "section_header:introduction"), (3, "references_block"), (4, "front_matter"), (5, "math_body"), (6, "figure_or_numeric"), (7, "figure_or_numeric"), (8, "body"),
    (9, "front_matter"), (10, "section_header:related work"),
))
def chunk_types(spark, sf_dir):
    rows = (" \n ", "References", "1.2 Introduction:\nmore", "so\n[12] A. Author", "me@there.org", "the Lemma holds", "see Figure 2", "a\n -3.5 \nb", "1. Introduction", "a theorem, University of X", "RELATED WORK\nx")
    return _numbered(spark, *rows).select("n", T.chunk_type("x").alias("chunk_type"))


@_query(_rows(
    "n arxiv_ids emails urls", (0, "2407.00703 math-ph/0101001", "", "https://arxiv.org/abs/2407.00703"), (1, "", "a@b.co z@y.org", ""), (2, "", "", "http://x.y/z https://x.y"), (3, "", "", ""),
))
def harvest_literal(spark, sf_dir):
    rows = ("arXiv:2407.00703 and ARXIV:math-ph/0101001 https://arxiv.org/abs/2407.00703", "z@y.org, a@b.co; z@y.org", "https://x.y http://x.y/z", None)
    h = T.harvest("x")
    return _numbered(spark, *rows).select("n", *[F.array_join(h[k], " ").alias(k) for k in ("arxiv_ids", "emails", "urls")])


@_query(_rows("n math_loss", (0, True), (1, True), (2, True), (3, True), (4, True), (5, True), (6, False), (7, False), (8, True)))
def math_loss_literal(spark, sf_dir):
    return _numbered(spark, "f( )", "a [ ] b", "**", "eq. 3", "\\alpha now", "V =", "clean words", " ", "a +\nb").select("n", T.math_loss("x").alias("math_loss"))


@_query(_rows("n labels refs equations", (0, "a s1", "a b", "$$x\\label{a}$$|$$x\\label{a}$"), (1, "e", "", "\\[ y \\label{e} \\]"), (2, "q", "", "\\begin{align*}z\\label{q}\\end{align*}"), (3, "", "sec", "")))
def math_and_labels(spark, sf_dir):
    rows = ('<div id="s1"> $$x\\label{a}$$ \\eqref{b} \\ref{a}', "\\[ y \\label{e} \\] \\[  y \\label{e} \\]", "\\begin{align*}z\\label{q}\\end{align*} $u$", '<a data-reference="sec">')
    return _numbered(spark, *rows).select("n", F.array_join(T.labels("x"), " ").alias("labels"), F.array_join(T.refs("x"), " ").alias("refs"), F.array_join(T.equations("x"), "|").alias("equations"))


@_query(_rows("n base_id version sanitized_id", (0, "2407.00703", "v2", "2407.00703v2"), (1, "2407.00703", "v1", "2407.00703v1"), (2, "math-ph/0101001", "v1", "0101001v1"), (3, "0101001", "v3", "0101001v3")))
def catalogue_ids(spark, sf_dir):
    rows = ("http://arxiv.org/abs/2407.00703v2", "http://arxiv.org/abs/2407.00703", "http://arxiv.org/abs/math-ph/0101001v1", "http://arxiv.org/abs/math.SP/0101001v3")
    return _numbered(spark, *rows).select("n", T.catalogue_id("x").alias("i")).select("n", "i.*")


@_query(_rows("n base stem paper keywords chosen", (0, "b.tar.gz", "b.tar", "b.tar", "x|y z", "T"), (1, ".hidden", ".hidden", "p1", "", "path"), (2, "c", "c", "p2", "one", "")))
def names_and_keys(spark, sf_dir):
    rows = [(0, "/a/b.tar.gz", None, "X, y Z ,,", " T ", "path"), (1, "/a/.hidden", "p1::L1-2::c0", "", " ", "path"), (2, "c", "p2::x", "one", None, None)]
    df = spark.createDataFrame(rows, "n int, file string, id string, words string, title string, path string")
    return df.select("n", T.basename("file").alias("base"), T.stem("file").alias("stem"), T.paper_id("id", "file").alias("paper"), F.array_join(T.keyword_field("words"), "|").alias("keywords"), T.section_choice("title", "path").alias("chosen"))


@_query(_rows("n text", (0, "ab"), (1, "é"), (2, "")))
def invalid_bytes(spark, sf_dir):
    df = spark.createDataFrame([(0, b"a\xffb"), (1, "é".encode()), (2, b"\xfe")], "n int, x binary")
    return df.select("n", T.drop_invalid("x").alias("text"))


# Chunks

_MD = "pre one\n\npre two\n# One\na\n\n```\n# not a heading\n\nstill\n```\n$$\n# nor this\n$$\n### Deep\nb $$x\\label{e1}$$\n### Deeper\nsee \\ref{e1} and \\eqref{e2}\n## Two\nc \\label{e2} \\ref{e2} \\ref{gone}\n#foo bar\nend"


def _md(spark):
    return spark.createDataFrame([("/d/m.md", _MD), ("/d/o.md", "\\label{e1}")], "file string, text string")


@_query(_rows(
    "file level title path start end", ("/d/m.md", 0, "", "", 1, 3), ("/d/m.md", 1, "One", "One", 4, 14), ("/d/m.md", 3, "Deep", "One / Deep", 15, 16), ("/d/m.md", 3, "Deeper", "One / Deep / Deeper", 17, 18),
    ("/d/m.md", 2, "Two", "One / Two", 19, 20), ("/d/m.md", 4, "bar", "One / Two / bar", 21, 22), ("/d/o.md", 0, "", "", 1, 1),
))
def md_sections_literal(spark, sf_dir):
    return chunk_md.sections(_md(spark)).select("file", F.inline("sections"))


@_query(_rows("src:BIGINT dst:BIGINT label", (3, 2, "e1"), (3, 4, "e2")).replace("::BIGINT", "::INTEGER"))
def md_reference_edges(spark, sf_dir):
    return chunk_md.reference_edges(chunk_md.chunk(_md(spark))).select("src", "dst", "label")


_IDS = ["m::L1-3::s0", "m::L4-14::s0", "m::L15-16::s0", "m::L17-18::s0", "m::L19-20::s0", "m::L21-22::s0"]


@_query(_rows(
    "id neighbor_id direction",
    *[x for a, b in zip(_IDS, _IDS[1:], strict=False) for x in ((a, b, "next"), (b, a, "previous"))],
    ("m::L17-18::s0", "m::L15-16::s0", "reference"), ("m::L17-18::s0", "m::L19-20::s0", "reference"), ("m::L15-16::s0", "m::L17-18::s0", "comment"), ("m::L19-20::s0", "m::L17-18::s0", "comment"),
))
def md_neighbors(spark, sf_dir):
    return chunk_md.link(chunk_md.chunk(_md(spark))).select("id", F.explode("neighbors").alias("n")).select("id", F.col("n.id").alias("neighbor_id"), "n.direction")


_P = "word " * 380  # 1,899 characters


@_query(_rows(
    "id section start_line end_line length", ("t::L1-2::c0", "Abstract", 1, 2, 1908), ("t::L4-4::c1", "Abstract", 4, 4, 3809), ("t::L6-8::c2", "Introduction", 6, 8, 1930),
))
def txt_sections_carry(spark, sf_dir):
    df = spark.createDataFrame([("/x/t.txt", f"Abstract\n{_P.strip()}\n\n{_P.strip()}\n\n1.2 Introduction:\n\nlast words")], "file string, text string")
    return chunk_txt.chunk(df).select("id", "section", "start_line", "end_line", F.length("text").alias("length"))


@_query(_rows("paper_ids files:BIGINT records:BIGINT", ("m", 1, 6)))
def md_report(spark, sf_dir):
    got = chunk_md.report(chunk_md.normalise(chunk_md.link(chunk_md.chunk(_md(spark).filter("file LIKE '%m.md'")))))
    return got.withColumn("paper_ids", F.array_join("paper_ids", " "))


# Catalogue

@_query(_rows("q", ('(all:"almost Mathieu operator" OR all:"x") AND (cat:math-ph OR cat:math.SP)',)))
def catalogue_query(spark, sf_dir):
    return spark.createDataFrame([(catalogue.search_query(["almost Mathieu operator", "x"], ["math-ph", "math.SP"]),)], "q string")


_OFFLINE = "docquarry.sources.offline"


def _papers(spark, most=300):
    return catalogue.papers(catalogue.scan(spark, catalogue.search_query(["x"], ["math-ph", "math.SP"]), f"{_OFFLINE}:fetch", most))


_K = "FROM range(130) AS r(k)"
_ARXIV = "'2401.' || (1000 + k)"


@_query(f"SELECT {_ARXIV} || 'v' || (1 + k % 3) AS arxiv_id, {_ARXIV} AS base_id, 'Title ' || k AS title, len(['A' || k, 'B' || k % 7])::INTEGER AS authors, CASE WHEN k % 4 = 0 THEN '2024-06-01' ELSE '2024-01-' || lpad((1 + k % 28)::VARCHAR, 2, '0') END AS updated_date {_K}")
def catalogue_papers(spark, sf_dir):
    return _papers(spark).select("arxiv_id", "base_id", "title", F.size("authors").alias("authors"), "updated_date")


@_query("SELECT 120::BIGINT AS n")
def catalogue_limit(spark, sf_dir):
    return _papers(spark, 120).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT {_ARXIV} || 'v' || (1 + k % 3) AS arxiv_id, CASE WHEN k % 5 = 0 THEN '2401.' || (1000 + (k + 1) % 130) || ' ' || '2401.' || (1000 + (k + 2) % 130) ELSE '' END AS cited_by {_K}")
def catalogue_citations(spark, sf_dir):
    p = _papers(spark)
    cited = catalogue.fetch_citations(p, f"{_OFFLINE}:citations", delay=0).withColumn("reference_list", F.array().cast("array<string>"))
    return catalogue.enrich(p, cited).select("arxiv_id", F.array_join("citation_list", " ").alias("cited_by"))


@_query(_rows("base_id version", ("a", "v2"), ("b", "v10")))
def catalogue_latest(spark, sf_dir):
    rows = [("a", "v1"), ("a", "v2"), ("b", "v9"), ("b", "v10")]
    return catalogue.latest_versions(spark.createDataFrame(rows, "base_id string, version string"))


@_query(_rows("base_id candidate priority", ("hep/1", "hep/1v1", 0), ("hep/1", "hep/1", 1), ("2401.1", "2401.1v2", 0)))
def catalogue_to_fetch(spark, sf_dir):
    papers = spark.createDataFrame([("hep/1", "v1"), ("2401.1", "v2"), ("2401.2", "v1")], "base_id string, version string")
    have = spark.createDataFrame([("2401.2", b"x"), ("2401.1", b"")], "base_id string, content binary")
    return catalogue.to_fetch(papers, have).select("base_id", "candidate", "priority")


@_query(_rows("base_id text", ("a", "t"), ("b", None)))
def catalogue_widen(spark, sf_dir):
    return catalogue.widen(spark.createDataFrame([("a",), ("b",)], "base_id string"), spark.createDataFrame([("a", "t")], "base_id string, text string"))


@_query(f"SELECT {_ARXIV} AS base_id, 'Title ' || k AS title, k % 9 <> 0 AS has_source, k % 9 <> 0 AS has_text {_K}")
def etl_report(spark, sf_dir):
    return jobs.run_etl(spark, ["x"], ["math-ph", "math.SP"], work_dir(spark, "etl"), f"{_OFFLINE}:fetch", f"{_OFFLINE}:archive", f"{_OFFLINE}:citations", delay=0)["report"]


@_query(rf"SELECT {_ARXIV} AS name, '\documentclass{{article}}' || chr(10) || '\begin{{document}}' || chr(10) || 'Text of ' || k || '. ' || chr(10) || '\end{{document}}' AS text {_K} WHERE k % 9 <> 0")
def etl_texts(spark, sf_dir):
    return jobs.run_etl(spark, ["x"], ["math-ph", "math.SP"], work_dir(spark, "etl"), f"{_OFFLINE}:fetch", f"{_OFFLINE}:archive", delay=0)["texts"]


# Files

@_query(_rows("disposition n:BIGINT", ("ok", 3), ("blank", 2), ("decode_error", 2)))
def jsonl_dispositions_literal(spark, sf_dir):
    path = work_dir(spark, "lines")
    lines = ('{"text": "a", "section": "Intro"}', "", "  ", "{bad", '{"text": ""}', '{"section": "proof of it"}', "[1")
    _numbered(spark, *lines).select("x").coalesce(1).write.text(path)
    return jsonl.scan(spark, path, "text string, section string").groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT (count(*) FILTER (trim(text) <> ''))::BIGINT AS indexed, 0::BIGINT AS skipped_blank, 0::BIGINT AS skipped_decode, (count(*) FILTER (trim(text) = ''))::BIGINT AS skipped_filter FROM conversations")
def jsonl_counters(spark, sf_dir):
    path = work_dir(spark, "rows")
    jsonl.write(_t(spark, sf_dir, "conversations"), path)
    return jsonl.counters(jsonl.scan(spark, path, "conv_id long, turn long, role string, text string"))


@_query("SELECT * FROM conversations")
def jsonl_strict(spark, sf_dir):
    path = work_dir(spark, "rows")
    jsonl.write(_t(spark, sf_dir, "conversations"), path)
    return jsonl.read_strict(spark, path, "conv_id long, turn long, role string, text string")


@_query("SELECT doc_id, source AS section FROM documents WHERE contains(lower(source), 'src1')")
def jsonl_matches(spark, sf_dir):
    path = work_dir(spark, "rows")
    jsonl.write(_t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section")), path)
    return jsonl.read_matches(spark, path, "doc_id long, section string", ["SRC1"])


@_query("SELECT conv_id, turn, text FROM conversations")
def chunk_arrays(spark, sf_dir):
    path = work_dir(spark, "arrays")
    sinks.write_arrays(_t(spark, sf_dir, "conversations").withColumn("name", F.col("conv_id")), path, "name", "turn")
    return jsonl.read_arrays(spark, path, "conv_id long, turn long, text string").select("conv_id", "turn", "text")


@_query("SELECT item_id::VARCHAR AS name, text FROM benchmark")
def text_files(spark, sf_dir):
    path = work_dir(spark, "texts")
    sinks.write_texts(_t(spark, sf_dir, "benchmark"), path, "item_id", "text")
    return sinks.read_texts(spark, path)


@_query("SELECT item_id, text FROM benchmark")
def tex_tree(spark, sf_dir):
    path = work_dir(spark, "tree")
    sinks.write_texts(_t(spark, sf_dir, "benchmark"), path, "item_id", "text")
    got = archives.read_tree(spark, path, "part-*")
    return got.select(F.regexp_extract("path", r"name=(\d+)", 1).cast("long").alias("item_id"), F.regexp_replace("text", r"\n\z", "").alias("text"))


# Indexes and upserts

@_query(f"WITH {_BM25_SQL} SELECT query_id, chunk_id, score FROM bm")
def opened_index_search(spark, sf_dir):
    path = work_dir(spark, "lexical")
    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    spec = index.LexicalSpec({"chunk_id": lambda: F.col("chunk_id"), "text": lambda: F.col("text")}, fields=("text",), keep=lambda: F.lit(True))
    index.build_lexical(chunks, path, spec)
    opened = index.open_lexical(spark, path)
    found = search.bm25_scores(_questions(spark, sf_dir), opened["postings"], opened["stats"])
    return search.top(found, search.CANDIDATES, F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "score")


@_query(f"WITH {_BM25_SQL} SELECT query_id, chunk_id, score FROM bm")
def upsert_search(spark, sf_dir):
    """Three merges, the first of them with old texts of every third document, give what an index built anew gives."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    store = index.lexical_store(spark, work_dir(spark, "upserts"), ("text",), 8)
    store.merge(docs.filter("chunk_id % 3 = 0").withColumn("text", F.lit("old words of the text")), "first", 0)
    store.merge(docs.filter("chunk_id % 2 = 0"), "second", 0)
    store.merge(docs.filter("chunk_id % 2 = 1"), "second", 1)
    store.merge(docs.filter("chunk_id % 2 = 1").withColumn("text", F.lit("replayed")), "second", 1)
    opened = index.open_lexical(spark, store.path)
    found = search.bm25_scores(_questions(spark, sf_dir), opened["postings"], opened["stats"])
    return search.top(found, search.CANDIDATES, F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "score")


@_query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_store(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    lo, hi = events.selectExpr("min(ts)", "max(ts)").first()
    store = upsert.Store(spark, work_dir(spark, "events"), "user_id", 4)
    early = F.col("ts") <= F.lit(lo + (hi - lo) / 2).cast("timestamp_ntz")
    for n, part in enumerate((events.filter(early), events.filter(~early))):
        store.merge(part, "w", n, F.struct("ts", "event_id"))
    return store.read().select("user_id", "event_id", "value")


@_query("SELECT DISTINCT len(embedding)::INTEGER AS dim FROM embeddings")
def collection_dim(spark, sf_dir):
    return spark.createDataFrame([(index.collection_dim(_t(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")),)], "dim int")


@_query("SELECT doc_id AS chunk_id, trim(text, e' \\t\\n\\r') AS text, source AS section, '' AS labels, lang AS paper_id, 0 AS year FROM documents WHERE trim(text, e' \\t\\n\\r') <> ''")
def md_index_documents(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("section"), F.lit(None).cast("array<string>").alias("labels"), F.col("lang").alias("paper_id"))
    return index.documents(d, index.MD_SPEC)


@_query(_rows("source collection dim bm25 topk", ("md", "md_chunks", 384, 200, 10), ("txt", "txt_chunks", 768, 200, 10)))
def branch_settings(spark, sf_dir):
    return spark.createDataFrame([(s, d.collection, d.expected_dim, d.bm25, d.topk) for s in ("md", "txt") for d in [settings.SearchSettings.of(s, "x", topk=0)]], "source string, collection string, dim int, bm25 int, topk int")


# Search and evaluation

@_query(
    "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents), p AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')[1:3] AS q FROM benchmark), "
    "s AS (SELECT query_id, doc_id AS chunk_id, count(*) FILTER (t[i:i + 2] = q)::DOUBLE AS score FROM p, t, unnest(range(1, len(t) - 1)) AS u(i) WHERE len(q) = 3 GROUP BY ALL HAVING score > 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 200"
)
def phrase_topk(spark, sf_dir):
    """The first three words of every question as a phrase."""
    three = F.array_join(F.slice(T.tokens("query"), 1, 3), " ")
    asked = _questions(spark, sf_dir).filter(F.size(T.tokens("query")) >= 3).select("query_id", three.alias("query"))
    return search.phrase_search(asked, _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@_query("SELECT * FROM (SELECT conv_id AS query_id, 'md' AS etl, turn AS rank, turn + 1 AS position FROM conversations UNION ALL SELECT conv_id, 'txt', turn, turn + 1 + count(*) OVER (PARTITION BY conv_id) FROM conversations)")
def union_tagged(spark, sf_dir):
    ranked = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"))
    return search.union_sources(ranked, ranked).withColumn("position", F.col("position").cast("long"))


@_query("(SELECT doc_id AS chunk_id, 'md' AS etl FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 20) UNION ALL (SELECT item_id, 'txt' FROM benchmark ORDER BY md5('3:' || item_id), item_id LIMIT 20)")
def tagged_samples(spark, sf_dir):
    md, txt = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"))
    return evaluate.tagged_samples(md, txt, 20, seed=3)


@_query(_rows("query_v1 query_v2", ("q", "q"), ("r", "s"), ("u", "u")))
def kept_queries(spark, sf_dir):
    rows = [("q", None, "OK"), ("", None, "OK"), ("r", "s", "update"), ("t", None, "fail"), ("u", None, None), (None, "v", "OK")]
    return evaluate.keep_queries(spark.createDataFrame(rows, "query_v1 string, query_v2 string, evaluation string")).select("query_v1", "query_v2")
