"""Scalar functions against plain Python models of the semantics, on literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T


def values(spark, rows, col):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(col).collect()]


TEXTS = ["", " ", "one", "two words", "a\x0cb\r\nc d\n", "x " * 50, "  nbsp  ", "ends in =\n", "eq: (1)", "Introduction", "1.2 Introduction:", "1. Introduction", "RELATED WORK\nbody", None]


def test_lines_are_splitlines(spark):
    got = values(spark, TEXTS, T.lines("t"))
    assert got == [(t or "").splitlines() for t in TEXTS]


def test_strip_and_estimate(spark):
    texts = [t for t in TEXTS if t is not None]
    assert values(spark, texts, T.strip("t")) == [t.strip() for t in texts]
    assert values(spark, texts, T.token_estimate("t")) == [max(1, min(2 * max(1, len(t.split())), len(t) // 4)) for t in texts]


@pytest.mark.parametrize("text,want", [("Explain \\lambda notation in detail", True), ("How does an eigenvalue relate to stability?", True), ("Summarize spectral theory basics", True), ("Describe classical mechanics concepts", False), ("What is the role of probability in physics?", False)])
def test_is_mathy(spark, text, want):
    assert values(spark, [text], T.is_mathy("t")) == [want]


def test_section_hint(spark):
    rows = ["Abstract", "1.2 Introduction:", "1. Introduction", "RELATED WORK", "Introduction to all", "  references \nmore"]
    assert values(spark, rows, T.section_hint("t")) == ["Abstract", "Introduction", "", "Related Work", "", "References"]


def test_chunk_type(spark):
    rows = {
        "": "empty", "References\n[1] a": "references_header", "Abstract\nwe": "section_header:abstract", "see [1]\n[2] b": "references_block", "a bibliography": "references_block",
        "mail a@b.org Theorem": "front_matter", "Department of": "front_matter", "By Lemma 2": "math_body", "lemmata": "body", "see Table 3": "figure_or_numeric", "x\n-1.5\ny": "figure_or_numeric", "tables": "body",
    }
    assert dict(zip(rows, values(spark, list(rows), T.chunk_type("t")), strict=True)) == rows


def test_math_loss(spark):
    rows = {"f( ) is": True, "[ ]": True, "a\n**\nb": True, "eq. 3": True, "see eq:main": True, "\\alpha x": True, "X1 = \nnext": True, "a +\nb": True, "clean text.": False, "": False, " ": False, "value 3": False}
    assert dict(zip(rows, values(spark, list(rows), T.math_loss("t")), strict=True)) == rows


def test_harvest(spark):
    t = "see arXiv:2407.00703 and https://arxiv.org/abs/math/0101001v2 arxiv:2407.00703 mail b@c.de a@b.org b@c.de http://x.y/z"
    (h,) = values(spark, [t], T.harvest("t"))
    assert h.arxiv_ids == ["2407.00703", "math/0101001v2"] and h.emails == ["a@b.org", "b@c.de"] and h.urls == ["http://x.y/z", "https://arxiv.org/abs/math/0101001v2"]


def test_labels_refs_equations(spark):
    t = r'\label{b} \label{a} <p class="x" id="p1"> \ref{r} \eqref{a} data-reference="q" $$x\label{a}$$ $y$ \[z\label{c}\] \begin{align*}k\label{d}\end{align*}'
    assert values(spark, [t], T.labels("t")) == [["a", "b", "c", "d", "p1"]]
    assert values(spark, [t], T.refs("t")) == [["a", "q", "r"]]
    assert len(values(spark, ["$$x\\label{a}$$"], T.equations("t"))[0]) == 2
    assert values(spark, ["\\[x  \\label{a}\\] \\[x \\label{a}\\] \\[no\\]"], T.equations("t")) == [["\\[x  \\label{a}\\]"]]


def test_ids(spark):
    rows = ["http://arxiv.org/abs/2407.00703v2", "http://arxiv.org/abs/2407.00703", "http://arxiv.org/abs/math-ph/0101001v1", "http://arxiv.org/abs/math.SP/0101001v3", "x/123"]
    got = [tuple(r) for r in values(spark, rows, T.catalogue_id("t"))]
    assert got == [("2407.00703", "v2", "2407.00703v2"), ("2407.00703", "v1", "2407.00703v1"), ("math-ph/0101001", "v1", "0101001v1"), ("0101001", "v3", "0101001v3"), ("123", "v1", "123v1")]
    assert values(spark, ["p::L1-2::c0", ""], T.paper_id("t", F.lit("/d/e.f.txt"))) == ["p", "e.f"]
    assert values(spark, ["", "i"], T.stable_chunk_id("t", F.lit(""), F.lit(3))) == ["paper::chunk3", "i"]


def test_render_tokens(spark):
    (got,) = values(spark, ["a \\[ x+y \\] b \\(q\\) \\[z\\]"], T.render_tokens("t"))
    assert [(r.kind, r.body) for r in got] == [("markdown", "a "), ("latex", "x+y"), ("markdown", " b $q$ "), ("latex", "z")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(T.cosine("a", "b").alias("c"), T.normalised("a").alias("n")).collect()
    assert rows[0]["c"] == pytest.approx(0.96) and rows[0]["n"] == pytest.approx([0.6, 0.8]) and rows[1]["c"] == 0 and rows[1]["n"] == [0, 0]


def test_drop_invalid(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "t binary")
    assert df.select(T.drop_invalid("t")).first()[0] == "ab"


def test_words_model(spark):
    rows = ["Über_9 x-y Z", "ÀB c's"]
    assert values(spark, rows, T.tokens("t")) == [re.findall(r"\w+", r.lower()) for r in rows]
