import gzip
import io
import json
import tarfile

from docquarry.operators import latex
from docquarry.plans import jobs
from docquarry.sources import archives, catalogue, jsonl


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    rows = [("a", tar({"main.tex": b"x", "../evil.tex": b"y", "d/e.tex": b"z"}), None), ("b", gzip.compress(b"gz"), 'attachment; filename="f.tex.gz"'), ("c", b"plain \xe9", None), ("d", b"\x00\x01", None), ("e", b"", None)]
    df = spark.createDataFrame([(k, bytearray(c), h) for k, c, h in rows], "paper string, content binary, header string")
    got = {(r["paper"], r["path"], r["text"], r["kind"]) for r in archives.expand(df, header_col="header").collect()}
    assert got == {("a", "main.tex", "x", "tar"), ("a", "d/e.tex", "z", "tar"), ("b", "f.tex", "gz", "gzip"), ("c", "c.tex", "plain é", "plain")}


MAIN = r"""\documentclass{x} % note
\title{T}\begin{document}
50\% of \input{sec/one} and \include{two}\input{one-missing}
\begin{figure}[h] a \begin{figure} b \end{figure} c \end{figure}
\includegraphics[width=1]{f.png} \input{two}
\begin{axis} open
\end{document}"""


def test_corpus(spark):
    files = {"main.tex": MAIN.encode(), "sec/one.tex": rb"ONE \input{two.tex} % gone", "two.tex": rb"TWO \input{main}", "zz.tex": rb"\documentclass{x}"}
    raw = spark.createDataFrame([("p", bytearray(tar(files))), ("q", bytearray(tar({"b.tex": b"B", "a.tex": b"A"})))], "paper string, content binary")
    got = {r["paper"]: r["text"] for r in jobs.prepare_corpus(raw).collect()}
    assert got["q"] == "A\n\nB"
    text = got["p"]
    assert text.count("TWO") == 1 and "ONE" in text and "50\\%" in text and "gone" not in text and "note" not in text
    assert "figure" not in text and "includegraphics" not in text and "\\begin{axis} open" in text


def test_strippers(spark):
    df = spark.createDataFrame([("a % b\n100\\% c%d\n%e\nf",)], "t string")
    assert df.select(latex.strip_comments("t")).first()[0] == "a \n100\\% c\n\nf"
    df = spark.createDataFrame([("  % skip\n\\section*{A} x   \\cmd[o]{y}z %c\nw",)], "t string")
    assert df.select(latex.naive_text("t")).first()[0] == " x z \nw"
    assert latex.remove_environments(r"a\begin{TABLE}x\end{table}b\begin{table*}[t]y\end{table*}c") == "abc"
    got = latex.convert(spark.createDataFrame([("\\a{b} c",), (None,)], "text string"), "text", "txt").collect()
    assert got[1]["converted"] is None and "c" in got[0]["converted"]


ENTRIES = [{"id": k} for k in range(120)]


def fetch(query, offset, limit):
    return [(f"http://arxiv.org/abs/2401.{k:05d}v1", f" T{k} ", "math-ph", ["math-ph"], [{"name": "N"}], "2024-01-01", None, query, None) for k in range(120)][offset : offset + limit]


def test_catalogue(spark):
    q = catalogue.search_query(["almost Mathieu operator", "b"], ["math-ph", "x"])
    assert q == '(all:"almost Mathieu operator" OR all:"b") AND (cat:math-ph OR cat:x)'
    spark.dataSource.register(catalogue.CatalogueSource)
    assert len(catalogue._Reader({"query": q, "max_results": "110", "fetch": "x:y"}).partitions()) == 3
    entries = spark.createDataFrame([*fetch(q, 0, 3), *fetch(q, 0, 1)], catalogue.ENTRY)
    p = catalogue.papers(entries)
    assert p.count() == 3 and {r["title"] for r in p.collect()} == {"T0", "T1", "T2"} and p.first()["updated_date"] == "2024-01-01" and p.first()["authors"] == ["N"]
    cites = spark.createDataFrame([("2401.00000v1", ["a", None], ["b"])], "arxiv_id string, citation_list array<string>, reference_list array<string>")
    full = {r["arxiv_id"]: r for r in catalogue.enrich(p, cites).collect()}
    assert full["2401.00000v1"]["citation_list"] == ["a", None] and full["2401.00001v1"]["reference_list"] == []
    have = spark.createDataFrame([("2401.00000", bytearray(b"x")), ("2401.00001", bytearray(b""))], "base_id string, content binary")
    assert [r["base_id"] for r in catalogue.available(p, have).collect()] == ["2401.00000"]
    assert {r["candidate"] for r in catalogue.to_fetch(p, have).collect()} == {"2401.00001v1", "2401.00002v1"}
    recs = spark.sql("SELECT array(named_struct('citedPaper', named_struct('externalIds', named_struct('ArXiv', '1')), 'citingPaper', cast(null AS struct<externalIds:struct<ArXiv:string>>)), named_struct('citedPaper', null, 'citingPaper', null)) AS r")
    assert recs.select(catalogue.neighbour_ids("r")).first()[0] == ["1", None]


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"chunk_id": "a", "text": "x", "section": "Intro"}), "", "   ", "{bad", json.dumps({"chunk_id": "b", "text": " "}), json.dumps({"chunk_id": "c"})]
    f = tmp_path / "x.jsonl"
    f.write_text("\n".join(lines) + "\n")
    schema = "chunk_id string, text string, section string"
    s = jsonl.scan(spark, str(f), schema)
    assert sorted(r["disposition"] for r in s.collect()) == ["blank", "blank", "decode_error", "ok", "ok", "ok"]
    assert tuple(jsonl.counters(s).first()) == (1, 2, 1, 2)
    assert [r["chunk_id"] for r in jsonl.read_matches(spark, str(f), schema, ["INTRO"]).collect()] == ["a"]
    jsonl.write(jsonl.read(spark, str(f), schema), str(tmp_path / "o"))
    assert '"text":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.json").write_text(json.dumps([{"chunk_id": "1"}, {"chunk_id": "2"}]))
    (tmp_path / "j/2.json").write_text(json.dumps({"chunk_id": "3"}))
    assert jsonl.read_arrays(spark, str(tmp_path / "j/*.json"), schema).count() == 3
