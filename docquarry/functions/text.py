"""Scalar text functions as Catalyst expressions.

White space and word classes are Unicode here ("(?U)"), lines end at every Unicode line break, and only LF ends a line for
``^`` and ``$`` ("(?d)").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks other than LF.
LINE_BREAKS = r"\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_WS = r"[\s\u001c-\u001f]"

# Patterns whose matches define the results.
LABEL = r"\\label\{([^}]+)\}"
REF = r"\\(?:eqref|ref)\{([^}]+)\}"
HTML_REF = r"""(?i)data-reference\s*=\s*["']([^"'\s]+)["']"""
HTML_ID = r"""(?i)<(?:div|span|section|h[1-6]|p|table|figure|figcaption)[^>]*\bid\s*=\s*["']([^"']+)["']"""
MATH_DISPLAY = r"(?s)\$\$(.+?)\$\$"
MATH_BRACKET = r"(?s)\\\[(.+?)\\\]"
MATH_ENV = r"(?s)\\begin\{(equation\*?|align\*?|gather\*?|multline\*?)\}(.+?)\\end\{\1\}"
MATH_INLINE = r"(?sU)\$(?!\s)(.+?)(?<!\s)\$"
ARXIV_ID = r"(?i)\barXiv:(\d{4}\.\d{4,5}|[a-z\-]+/\d{7})\b"
ARXIV_URL = r"(?iU)https?://arxiv\.org/abs/([^\s]+)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = r"(?U)https?://\S+"
SECTION = (
    r"(?iU)^\s*(?:\d+(?:\.\d+)*)?\s*(abstract|introduction|preliminaries|related work|results|"
    r"proofs?|conclusion|acknowledg(?:e)?ments?|references?)\s*:??\s*$"
)
MATH_LOSS = (
    r"(?imdU)\(\s*\)|\[\s*\]|\{\s*\}|^\*{1,3}\s*$|^eq(\.|:)|eq:\w+|"
    r"\\(alpha|beta|gamma|lambda|Delta|nabla)\b|\b[A-Z]\w*\s*=\s*$"
)
OPERATOR_END = r"(?mdU)[=+\-*/]\s*$"
REFERENCE_LINE = r"(?mdU)^\s*\[\s*\d+\s*\]"
MATH_WORD = r"(?iU)\b(theorem|lemma|proposition|corollary|definition)\b"
FIGURE_WORD = r"(?iU)\bfigure\b|\btable\b"
NUMERIC_LINE = r"(?mdU)^\s*-?\d+(\.\d+)?\s*$"
MATHY_TOKENS = ("\\lambda", "\\sum", "\\nabla", "\\alpha", "\\beta", "$", "eigenvalue", "spectral", "laplacian")
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"
TOKEN = r"[\p{L}\p{N}_]+"
CATALOGUE_ID = r"arxiv\.org/abs/([0-9]+\.[0-9]+|[a-z\-]+/[0-9]+)v?(\d+)?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside another function's lambda a plain column would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(_c(x), rf"(?U)^{_WS}+|{_WS}+\z", "")


def collapse(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), rf"(?U){_WS}+", " "))


def lines(x: Column | str) -> Column:
    """The lines of a text; a line break at the end opens no further line; an empty text has none."""
    t = F.regexp_replace(_c(x), LINE_BREAKS, "\n")
    t = F.regexp_replace(t, r"\n\z", "")
    return F.when(F.coalesce(F.length(_c(x)), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))


def first_line(x: Column | str) -> Column:
    return strip(F.element_at(F.split(F.regexp_replace(strip(x), LINE_BREAKS, "\n"), "\n", 2), 1))


def drop_invalid(x: Column | str) -> Column:
    """Bytes as UTF-8 text, bad bytes left out."""
    return F.replace(F.make_valid_utf8(_c(x).cast("string")), F.lit("\ufffd"), F.lit(""))


def token_estimate(x: Column | str) -> Column:
    """max(1, min(2 * max(1, words), code points // 4)); 1 for blank texts."""
    words = F.regexp_count(F.coalesce(_c(x), F.lit("")), F.lit(r"(?U)\S+"))
    return F.greatest(F.lit(1), F.least(F.greatest(words, F.lit(1)) * 2, F.floor(F.length(F.coalesce(_c(x), F.lit(""))) / 4))).cast("int")


def context_estimate(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(_c(x), F.lit(""))) / 4)).cast("int")


def is_mathy(x: Column | str) -> Column:
    low, out = F.lower(_c(x)), F.lit(False)
    for t in MATHY_TOKENS:
        out = out | F.contains(low, F.lit(t))
    return out


def section_name(x: Column | str) -> Column:
    """The section that a text's first line names, lower case, or ''."""
    return F.lower(F.regexp_extract(first_line(x), SECTION, 1))


def section_hint(x: Column | str, name: Column | None = None) -> Column:
    return F.initcap(section_name(x) if name is None else name)


def math_loss(x: Column | str) -> Column:
    t = F.coalesce(_c(x), F.lit(""))
    return (strip(t) != "") & (t.rlike(MATH_LOSS) | t.rlike(OPERATOR_END))


def chunk_type(x: Column | str, name: Column | None = None) -> Column:
    """The kind of a chunk; ``name`` is its section_name, where that is known already."""
    t = strip(F.coalesce(_c(x), F.lit(""))) if name is None else _c(x)
    low, name = F.lower(t), section_name(t) if name is None else name
    return (
        F.when(t == "", "empty")
        .when(name.startswith("reference"), "references_header")
        .when(name != "", F.concat(F.lit("section_header:"), name))
        .when(F.contains(low, F.lit("abbrv")) | F.contains(low, F.lit("bibliography")) | t.rlike(REFERENCE_LINE), "references_block")
        .when(t.rlike(EMAIL) | F.contains(low, F.lit("university")) | F.contains(low, F.lit("department")), "front_matter")
        .when(t.rlike(MATH_WORD), "math_body")
        .when(t.rlike(FIGURE_WORD) | t.rlike(NUMERIC_LINE), "figure_or_numeric")
        .otherwise("body")
    )


def _all(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(group))


def sorted_set(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def harvest(x: Column | str) -> Column:
    """struct(arxiv_ids, emails, urls), each a sorted set."""
    t = _c(x)
    return F.struct(
        sorted_set(_all(t, ARXIV_ID, 1), _all(t, ARXIV_URL, 1)).alias("arxiv_ids"),
        sorted_set(_all(t, EMAIL, 0)).alias("emails"), sorted_set(_all(t, URL, 0)).alias("urls"),
    )


def labels(x: Column | str) -> Column:
    return sorted_set(_all(_c(x), LABEL, 1), _all(_c(x), HTML_ID, 1))


def refs(x: Column | str) -> Column:
    return sorted_set(_all(_c(x), REF, 1), _all(_c(x), HTML_REF, 1))


def equations(x: Column | str) -> Column:
    """Labelled equations by the four notations in turn; of those equal up to white space the first stays."""
    t = _c(x)
    found = F.concat(*(_all(t, p, 0) for p in (MATH_DISPLAY, MATH_BRACKET, MATH_ENV, MATH_INLINE)))
    found = F.filter(F.transform(found, strip), lambda e: F.contains(e, F.lit("\\label")))
    found = F.transform(found, lambda e: F.struct(e.alias("e"), collapse(e).alias("key")))
    firsts = lambda es: let(F.transform(es, lambda x: x["key"]), lambda keys: F.filter(es, lambda x, i: F.array_position(keys, x["key"]) == i + 1))
    return F.transform(let(found, firsts), lambda x: x["e"])


def tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(x: Column | str) -> Column:
    return F.regexp_count(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(TOKEN))


def stable_int_id(x: Column | str) -> Column:
    """60 bits of SHA-1 as a number: the key of a point."""
    return F.conv(F.substring(F.sha1(_c(x).cast("binary")), 1, 15), 16, 10).cast("bigint")


def paper_id(chunk_id: Column | str, file: Column | str) -> Column:
    i, f = F.coalesce(_c(chunk_id), F.lit("")), F.coalesce(_c(file), F.lit(""))
    return F.when(F.contains(i, F.lit("::")), F.substring_index(i, "::", 1)).otherwise(stem(f))


def basename(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"([^/]*)/*$", 1)


def stem(x: Column | str) -> Column:
    return F.regexp_replace(basename(x), r"(?<=.)\.[^.]*$", "")


def section_choice(title: Column | str, section_path: Column | str) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), strip(F.coalesce(_c(section_path), F.lit(""))))


def stable_chunk_id(chunk_id: Column | str, paper: Column | str, n: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(chunk_id), F.lit("")), F.concat(F.coalesce(F.nullif(_c(paper), F.lit("")), F.lit("paper")), F.lit("::chunk"), _c(n).cast("string")))


def keyword_in_section(section: Column | str, section_path: Column | str, keywords: list[str]) -> Column:
    """Any keyword inside section and section path, which are joined without a gap."""
    both = F.concat(F.lower(F.coalesce(_c(section), F.lit(""))), F.lower(F.coalesce(_c(section_path), F.lit(""))))
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(both, F.lit(k.lower()))
    return out


def keyword_field(x: Column | str) -> Column:
    """The analyser of comma-separated keyword fields."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), ","), lambda k: F.trim(k)), lambda k: k != "")


def catalogue_id(entry: Column | str) -> Column:
    """struct(base_id, version, sanitized_id) of a catalogue entry's URL."""
    e = _c(entry)
    hit, number = F.regexp_extract(e, CATALOGUE_ID, 1), F.regexp_extract(e, CATALOGUE_ID, 2)
    tail = F.substring_index(e, "/", -1)
    has_v = F.contains(tail, F.lit("v"))
    base = F.when(hit != "", hit).when(has_v, F.substring_index(tail, "v", 1)).otherwise(tail)
    version = F.when(hit != "", F.concat(F.lit("v"), F.when(number != "", number).otherwise("1"))).when(has_v, F.concat(F.lit("v"), F.regexp_extract(tail, r"^[^v]*v(.*)$", 1))).otherwise("v1")
    number_part = F.coalesce(F.nullif(F.substring_index(base, "/", -1), F.lit("")), base)
    return F.struct(base.alias("base_id"), version.alias("version"), F.concat(number_part, version).alias("sanitized_id"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 if a vector is zero."""
    a, b = _c(a), _c(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column | str) -> Column:
    v = _c(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def render_tokens(x: Column | str) -> Column:
    """array(struct(kind, body)): display maths between \\[ and \\] apart from Markdown."""
    t = F.replace(_c(x), F.lit("\\\\"), F.lit("\\"))
    t = F.replace(F.replace(t, F.lit("\\("), F.lit("$")), F.lit("\\)"), F.lit("$"))
    parts = F.filter(F.split(t, r"(?s)(?=\\\[.*?\\\])|(?<=\\\])"), lambda p: p != "")
    is_math = lambda p: p.startswith("\\[") & p.endswith("\\]")
    return F.transform(parts, lambda p: F.struct(F.when(is_math(p), "latex").otherwise("markdown").alias("kind"), F.when(is_math(p), strip(F.substring(p, F.lit(3), F.length(p) - 4))).otherwise(p).alias("body")))
