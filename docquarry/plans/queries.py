"""One query for each operator group over the driver's tables, and SQL that gives the same rows where SQL can.

Documents stand in for papers' texts and chunks, benchmark items and turns of conversations for questions, embeddings for
the chunks' vectors (vec_id = doc_id), pages for Markdown sources, events for streams of keyed records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk_md, chunk_txt, evaluate, index, latex, plugins, rag, search
from ..sources.layout import spread
from ..streaming import upsert

#: One place for each name: (query, SQL or None).
_ALL: dict = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def put(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return put


def _docs(spark, sf_dir, **cols: Column) -> DataFrame:
    return spread(_t(spark, sf_dir, "documents")).select("doc_id", *[c.alias(n) for n, c in cols.items()])


# Scalar functions

_WORDS = r"len(regexp_extract_all(text, '\S+'))"


@_query(f"SELECT doc_id, greatest(1, least(greatest({_WORDS}, 1) * 2, length(text) // 4))::INTEGER AS token_estimate, greatest(1, length(text) // 4)::INTEGER AS context_estimate FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir, token_estimate=T.token_estimate("text"), context_estimate=T.context_estimate("text"))


@_query("SELECT conv_id, turn, (" + " OR ".join(f"contains(lower(text), '{t}')" for t in T.MATHY_TOKENS) + ") AS is_mathy FROM conversations")
def is_mathy(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_mathy("text").alias("is_mathy"))


_SECTION_SQL = r"'(?i)^\s*(?:\d+(?:\.\d+)*)?\s*(abstract|introduction|preliminaries|related work|results|proofs?|conclusion|acknowledg(?:e)?ments?|references?)\s*:??\s*$'"
_FIRST_SQL = r"trim(split_part(trim(text, e' \t\n\r'), chr(10), 1), e' \t\r')"


_TYPE_SQL = r"""CASE WHEN t = '' THEN 'empty' WHEN name LIKE 'reference%' THEN 'references_header' WHEN name <> '' THEN 'section_header:' || name
  WHEN contains(low, 'abbrv') OR contains(low, 'bibliography') OR regexp_matches(t, '(?m)^\s*\[\s*\d+\s*\]') THEN 'references_block'
  WHEN regexp_matches(t, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') OR contains(low, 'university') OR contains(low, 'department') THEN 'front_matter'
  WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(theorem|lemma|proposition|corollary|definition)([^\p{L}\p{N}_]|$)') THEN 'math_body'
  WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(figure|table)([^\p{L}\p{N}_]|$)') OR regexp_matches(t, '(?m)^\s*-?\d+(\.\d+)?\s*$') THEN 'figure_or_numeric'
  ELSE 'body' END"""


@_query(rf"WITH f AS (SELECT doc_id, trim(text, e' \t\n\r') AS t, lower(text) AS low, lower(regexp_extract({_FIRST_SQL}, {_SECTION_SQL}, 1)) AS name FROM documents) SELECT doc_id, {_TYPE_SQL} AS chunk_type FROM f")
def chunk_type(spark, sf_dir):
    return _docs(spark, sf_dir, chunk_type=T.chunk_type("text"))


_LOSS_SQL = r"""(trim(text, e' \t\n\r') <> '' AND (regexp_matches(text, '(?im)\(\s*\)|\[\s*\]|\{\s*\}|^\*{1,3}\s*$|^eq(\.|:)|eq:[\p{L}\p{N}_]+|\\(alpha|beta|gamma|lambda|Delta|nabla)\b|(^|[^\p{L}\p{N}_])[A-Z][\p{L}\p{N}_]*\s*=\s*$')
    OR regexp_matches(text, '(?m)[=+\-*/]\s*$')))"""


@_query(f"SELECT doc_id, {_LOSS_SQL} AS math_loss FROM documents")
def math_loss(spark, sf_dir):
    return _docs(spark, sf_dir, math_loss=T.math_loss("text"))


@_query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)\barXiv:(\d{4}\.\d{4,5}|[a-z\-]+/\d{7})\b', 1) || regexp_extract_all(text, '(?i)https?://arxiv\.org/abs/([^\s]+)', 1))), ' ') AS arxiv_ids,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'))), ' ') AS emails,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'https?://\S+'))), ' ') AS urls FROM documents"""
)
def harvest_refs(spark, sf_dir):
    h = T.harvest("text")
    return _docs(spark, sf_dir, **{k: F.array_join(h[k], " ") for k in ("arxiv_ids", "emails", "urls")})


@_query("SELECT doc_id, ('0x' || substr(sha1('doc' || doc_id), 1, 15))::BIGINT AS point_id FROM documents")
def stable_int_id(spark, sf_dir):
    return _docs(spark, sf_dir, point_id=T.stable_int_id(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))))


@_query(rf"SELECT doc_id, regexp_extract({_FIRST_SQL}, {_SECTION_SQL}, 1) <> '' AS has_section FROM documents")
def section_hint(spark, sf_dir):
    return _docs(spark, sf_dir, has_section=T.section_hint("text") != "")


@_query("SELECT doc_id FROM documents WHERE contains(lower(source) || lower(lang), 'src1e') OR contains(lower(source) || lower(lang), 'src3')")
def keyword_section_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter(T.keyword_in_section("source", "lang", ["SRC1e", "src3"])).select("doc_id")


@_query(r"SELECT doc_id, regexp_replace(text, '(^|[^\\])%[^\n]*', '\1', 'g') AS body FROM documents")
def strip_comments(spark, sf_dir):
    return _docs(spark, sf_dir, body=latex.strip_comments("text"))


@_query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT starts_with(ltrim(l, e' \t'), '%')), chr(10)),
    '\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?', '', 'g'), '(^|[^\\])%[^\n]*', '\1', 'g'), '[ \t]+', ' ', 'g') AS body FROM documents"""
)
def naive_tex_text(spark, sf_dir):
    return _docs(spark, sf_dir, body=latex.naive_text("text"))


@_query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, 'arxiv\.org/abs/([0-9]+\.[0-9]+|[a-z\-]+/[0-9]+)v?(\d+)?', 1) AS hit, string_split(url, '/')[-1] AS tail FROM pages),
    b AS (SELECT page_id, CASE WHEN hit <> '' THEN hit WHEN contains(tail, 'v') THEN split_part(tail, 'v', 1) ELSE tail END AS base_id, CASE WHEN contains(tail, 'v') THEN 'v' || substr(tail, instr(tail, 'v') + 1) ELSE 'v1' END AS version FROM p)
    SELECT page_id, base_id, version, base_id || version AS sanitized_id FROM b"""
)
def parse_catalogue_id(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.catalogue_id("url").alias("i")).select("page_id", "i.*")


# Text chunks

@_query(
    r"""SELECT doc_id, u.n::INTEGER AS line_no, length(l[u.n]) AS line_len FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''), unnest(range(1, len(l) + 1)) AS u(n)"""
)
def line_scan(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("line_len"))


_LINES_SQL = r"list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: trim(x, e' \t\r'))"
_PARAS_SQL = rf"""
lines AS (SELECT doc_id, n, l[n] AS s FROM (SELECT doc_id, {_LINES_SQL} AS l FROM documents WHERE text <> ''), unnest(range(1, len(l) + 1)) AS u(n)),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM lines WHERE s <> ''),
paras AS (SELECT doc_id, min(n) AS start_line, max(n) AS end_line, string_agg(s, chr(10) ORDER BY n) AS text FROM runs GROUP BY doc_id, g
          HAVING length(regexp_replace(string_agg(s, chr(10) ORDER BY n), '[^0-9A-Za-z]+', '', 'g')) > 2 OR contains(string_agg(s, chr(10) ORDER BY n), ' '))"""


@_query(f"WITH {_PARAS_SQL} SELECT doc_id, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, text FROM paras")
def paragraphs(spark, sf_dir):
    p = _t(spark, sf_dir, "documents").select("doc_id", F.explode(chunk_txt.paragraphs("text")).alias("p"))
    return p.select("doc_id", F.col("p.start").alias("start_line"), F.col("p.end").alias("end_line"), "p.text")


def _fold(parts: str) -> str:
    step = (
        "lambda acc, el: CASE WHEN acc.now = '' THEN {'done': acc.done, 'now': el} WHEN length(acc.now) + length(el) + 1 <= 1800 THEN {'done': acc.done, 'now': acc.now || ' ' || el} "
        "ELSE {'done': list_append(acc.done, acc.now), 'now': el} END"
    )
    return f"list_reduce({parts}, {step}, {{'done': []::VARCHAR[], 'now': ''}})"


_SPLIT_SQL = rf"""
flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
sent AS (SELECT doc_id, t, {_fold(r"list_filter(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')")} AS r FROM flat WHERE length(t) > 1800),
wide AS (SELECT doc_id, u.k, x[u.k] AS s FROM (SELECT doc_id, CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END AS x FROM sent), unnest(range(1, len(x) + 1)) AS u(k)),
word AS (SELECT doc_id, k, CASE WHEN length(s) <= 1800 THEN {{'done': [s], 'now': ''}} ELSE {_fold("string_split(s, ' ')")} END AS r FROM wide),
segs AS (SELECT doc_id, k, u.j, y[u.j] AS seg FROM (SELECT doc_id, k, CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END AS y FROM word), unnest(range(1, len(y) + 1)) AS u(j)
         UNION ALL SELECT doc_id, 1, 1, t FROM flat WHERE t <> '' AND length(t) <= 1800)"""


@_query(f"WITH {_SPLIT_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INTEGER AS pos, seg FROM segs")
def split_long_paragraph(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk_txt.split_long("text")).alias("pos", "seg"))


def _files(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file"), "text")


def _greedy(name: str, items: str, key: str, gap: int, lead: int) -> str:
    """Of items (key, n from 1, txt): (key, n, c), the number of the chunk that the greedy packing gives each."""
    grown = f"{name}.size + length(i.txt) + {gap}"
    cut = f"({grown} > 2400 OR ({grown} > 1800 AND {name}.size >= 200))"
    return (
        f"{name}({key}, n, size, c) AS (SELECT {key}, n, length(txt) + {lead}, 0 FROM {items} WHERE n = 1 UNION ALL "
        f"SELECT i.{key}, i.n, CASE WHEN {cut} THEN length(i.txt) + {lead} ELSE {grown} END, {name}.c + {cut}::INT FROM {name} JOIN {items} i ON i.{key} = {name}.{key} AND i.n = {name}.n + 1)"
    )


def _merged(items: str, packed: str, key: str) -> str:
    """(key, c, start_line, end_line, text): the texts of each chunk with the last one before it."""
    return rf"""SELECT i.{key}, p.c, min(start_line) AS start_line, max(end_line) AS end_line, max(i.n) AS last,
      trim(coalesce((SELECT o.txt || e'\n\n' FROM {items} o WHERE o.{key} = i.{key} AND o.n = min(i.n) - 1 AND trim(o.txt, e' \t\n\r') <> ''), '') || string_agg(txt, e'\n\n' ORDER BY i.n), e' \t\n\r') AS text
      FROM {items} i JOIN {packed} p ON p.{key} = i.{key} AND p.n = i.n GROUP BY i.{key}, p.c"""


_TITLE_SQL = "CASE name WHEN 'related work' THEN 'Related Work' ELSE upper(left(name, 1)) || substr(name, 2) END"
_TXT_SQL = rf"""
{_PARAS_SQL},
long AS (SELECT doc_id, start_line, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM paras WHERE length(text) > 2400),
sent AS (SELECT doc_id, start_line, CASE WHEN length(t) <= 1800 THEN {{'done': [t], 'now': ''}} ELSE {_fold(r"list_filter(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')")} END AS r FROM long),
wide AS (SELECT doc_id, start_line, u.k, x[u.k] AS s FROM (SELECT doc_id, start_line, CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END AS x FROM sent), unnest(range(1, len(x) + 1)) AS u(k)),
word AS (SELECT doc_id, start_line, k, CASE WHEN length(s) <= 1800 THEN {{'done': [s], 'now': ''}} ELSE {_fold("string_split(s, ' ')")} END AS r FROM wide),
segs AS (SELECT doc_id, start_line, k, u.j, y[u.j] AS seg FROM (SELECT doc_id, start_line, k, CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END AS y FROM word), unnest(range(1, len(y) + 1)) AS u(j)),
items AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.start_line, k, j) AS n, p.start_line, p.end_line, coalesce(seg, p.text) AS txt,
          lower(regexp_extract(split_part(p.text, chr(10), 1), {_SECTION_SQL}, 1)) AS name FROM paras p LEFT JOIN segs s ON s.doc_id = p.doc_id AND s.start_line = p.start_line),
{_greedy("g", "items", "doc_id", 2, 0)},
raw AS (SELECT *, 'doc' || doc_id || '::L' || start_line || '-' || end_line || '::c' || c AS id FROM ({_merged("items", "g", "doc_id")}))"""


@_query(
    rf"""WITH RECURSIVE {_TXT_SQL},
f AS (SELECT id, doc_id, start_line, end_line, text, text AS t, lower(text) AS low, lower(regexp_extract({_FIRST_SQL}, {_SECTION_SQL}, 1)) AS name,
      (SELECT arg_max({_TITLE_SQL}, n) FROM items i WHERE i.doc_id = raw.doc_id AND i.n <= raw.last AND name <> '') AS held FROM raw)
SELECT id AS chunk_id, 'doc' || doc_id AS paper_id, coalesce(held, nullif({_TITLE_SQL}, ''), left({_FIRST_SQL}, 120)) AS section, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, {_TYPE_SQL} AS chunk_type, text,
  length(text)::INTEGER AS text_len, greatest(1, least(greatest({_WORDS}, 1) * 2, length(text) // 4))::INTEGER AS token_estimate, {_LOSS_SQL} AS has_math_loss FROM f WHERE text <> ''"""
)
def txt_chunks(spark, sf_dir):
    return chunk_txt.normalise(chunk_txt.chunk(_files(spark, sf_dir))).select("chunk_id", "paper_id", "section", "start_line", "end_line", "chunk_type", "text", "text_len", "token_estimate", "has_math_loss")


@_query(rf"WITH RECURSIVE {_TXT_SQL} SELECT a.id, b.id AS neighbor_id, CASE WHEN b.c < a.c THEN 'previous' ELSE 'next' END AS direction FROM raw a JOIN raw b ON a.doc_id = b.doc_id AND abs(a.c - b.c) = 1")
def txt_neighbors(spark, sf_dir):
    return chunk_txt.chunk(_files(spark, sf_dir)).select("id", F.explode("neighbors").alias("n")).select("id", F.col("n.id").alias("neighbor_id"), "n.direction")


# Markdown chunks (from pages)

def _markdown(spark, sf_dir) -> DataFrame:
    return chunk_md.html_to_markdown(_t(spark, sf_dir, "pages"))


_HEADS_SQL = "replace(replace(replace(regexp_replace(regexp_replace(%s, '(?is)<(p|div|li|tr|article|section|br)\\b[^>]*>', e'\\n\\n', 'g'), '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _html_sql() -> str:
    h = "regexp_replace(html, '(?is)" + "|".join(rf"<{t}\b.*?</{t}>" for t in ("script", "style", "nav", "footer", "head")) + "', '', 'g')"
    for level in range(6, 0, -1):
        h = rf"regexp_replace({h}, '(?is)<h{level}\b[^>]*>(.*?)</h{level}>', e'\n\n{'#' * level} \\1\n\n', 'g')"
    return rf"trim(regexp_replace({_HEADS_SQL % h}, '\n{{3,}}', e'\n\n', 'g'), e' \t\n\r')"


# Sections of one level, without fences: what the pages hold.
_MD_SQL = rf"""
md AS (SELECT 'page' || page_id AS page, {_html_sql()} AS t FROM pages),
mdlines AS (SELECT page, u.n, l[u.n] AS s FROM (SELECT page, string_split(t, chr(10)) AS l FROM md WHERE t <> ''), unnest(range(1, len(l) + 1)) AS u(n)),
marked AS (SELECT *, starts_with(ltrim(s, e' \t'), '#') AS head, trim(s, e' \t\r') = '' AS blank FROM mdlines),
placed AS (SELECT *, sum(head::INT) OVER w AS sec, sum(head::INT) OVER w + coalesce(sum(blank::INT) OVER (PARTITION BY page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS par FROM marked WINDOW w AS (PARTITION BY page ORDER BY n)),
heads AS (SELECT page, sec, length(regexp_extract(ltrim(s, e' \t'), '^\S+')) AS level, substr(ltrim(s, e' \t'), instr(ltrim(s, e' \t'), ' ') + 1) AS title FROM placed WHERE head),
mparas AS (SELECT page || ':' || sec AS sid, page, sec, min(n) AS start_line, max(n) AS end_line, rtrim(string_agg(s, chr(10) ORDER BY n), e' \t\n\r') AS txt FROM placed GROUP BY page, sec, par),
mitems AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY start_line) AS n FROM mparas)"""


@_query(
    rf"""WITH {_MD_SQL} SELECT m.page || '.md' AS file, coalesce(level, 0)::INTEGER AS level, coalesce(title, '') AS title, coalesce(trim(title), '') AS path, min(start_line)::INTEGER AS start, max(end_line)::INTEGER AS "end"
    FROM mitems m LEFT JOIN heads USING (page, sec) GROUP BY m.page, sec, level, title"""
)
def md_sections(spark, sf_dir):
    return chunk_md.sections(_markdown(spark, sf_dir)).select("file", F.inline("sections"))


@_query(
    rf"""WITH RECURSIVE {_MD_SQL}, {_greedy("mg", "mitems", "sid", 1, 1)}, mraw AS ({_merged("mitems", "mg", "sid")}),
    f AS (SELECT split_part(r.sid, ':', 1) AS page, coalesce(trim(title), '') AS section, r.c, start_line, end_line, text,
          count(*) OVER (PARTITION BY split_part(r.sid, ':', 1)) AS many, row_number() OVER (PARTITION BY split_part(r.sid, ':', 1) ORDER BY start_line) AS pos FROM mraw r LEFT JOIN heads h ON h.page || ':' || h.sec = r.sid)
    SELECT page || '::L' || start_line || '-' || end_line || '::s' || c AS chunk_id, page AS paper_id, section, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, text, length(text)::INTEGER AS text_len,
      greatest(1, least(greatest({_WORDS}, 1) * 2, length(text) // 4))::INTEGER AS token_estimate, 0 AS equation_count, ((pos > 1)::INT + (pos < many)::INT) AS n_neighbors FROM f WHERE text <> ''"""
)
def md_chunks(spark, sf_dir):
    return chunk_md.normalise(chunk_md.link(chunk_md.chunk(_markdown(spark, sf_dir)))).select("chunk_id", "paper_id", "section", "start_line", "end_line", "text", "text_len", "token_estimate", "equation_count", F.size("neighbors").alias("n_neighbors"))


# Indexes

@_query(r"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term")
def document_frequency(spark, sf_dir):
    post = index.postings(spread(_t(spark, sf_dir, "documents")), "doc_id", ("text",))
    return index.document_frequency(post).select("term", "df")


@_query(r"SELECT 'text' AS field, term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY ALL")
def postings(spark, sf_dir):
    return index.postings(_t(spark, sf_dir, "documents"), "doc_id", ("text",)).select("field", "term", "chunk_id", "tf")


@_query(r"SELECT 'text' AS field, count(*) AS n_docs, avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS avg_len FROM documents")
def bm25_stats(spark, sf_dir):
    return index.field_stats(_t(spark, sf_dir, "documents"), ("text",))


@_query(r"SELECT count(*) FILTER (trim(coalesce(text, ''), e' \t\n\r') <> '') AS indexed, count(*) FILTER (trim(coalesce(text, ''), e' \t\n\r') = '') AS skipped_filter FROM documents")
def index_counters(spark, sf_dir):
    return index.admission_counters(_t(spark, sf_dir, "documents"), index.MD_SPEC)


@_query("SELECT array_to_string(list_sort(list(DISTINCT source)), ' ') AS paper_ids, count(DISTINCT lang) AS files, count(*) AS records FROM documents")
def chunk_report(spark, sf_dir):
    got = chunk_md.report(_t(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("lang").alias("source_file")))
    return got.withColumn("paper_ids", F.array_join("paper_ids", " "))


# Search

def _questions(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(spark, sf_dir, k=search.CANDIDATES) -> DataFrame:
    return search.bm25_search(_questions(spark, sf_dir), _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), k)


def _dense(spark, sf_dir, k=search.CANDIDATES) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    asked = _questions(spark, sf_dir).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("query_vec"))
    return search.dense_search(asked, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), k)


_BM25_SQL = r"""
tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 200)"""
_DENSE_SQL = """
qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id),
ds AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(v, embedding::DOUBLE[]) / sqrt(list_dot_product(v, v) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM qv, embeddings),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds) WHERE rank <= 200)"""
_RRF_SQL = """
fu AS (SELECT coalesce(bm.query_id, dn.query_id) AS query_id, coalesce(bm.chunk_id, dn.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + bm.rank), 0) + coalesce(1.0::DOUBLE / (60 + dn.rank), 0), 9) AS fused_score,
       bm.rank AS r0, dn.rank AS r1, coalesce(bm.score, 0.0) AS bm25_score, coalesce(dn.score, 0.0) AS dense_score
       FROM bm FULL JOIN dn ON bm.query_id = dn.query_id AND bm.chunk_id = dn.chunk_id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, r0 NULLS LAST, r1 NULLS LAST) AS rank FROM fu) WHERE rank <= 10)"""


@_query(f"WITH {_BM25_SQL} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM bm")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


@_query(f"WITH {_DENSE_SQL} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM dn")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


@_query(f"WITH {_BM25_SQL}, {_DENSE_SQL}, {_RRF_SQL} SELECT query_id, chunk_id, fused_score AS fused, r0::INTEGER AS r0, r1::INTEGER AS r1 FROM fu")
def rrf_fuse(spark, sf_dir):
    return search.rrf_fuse(_bm25(spark, sf_dir), _dense(spark, sf_dir)).select("query_id", "chunk_id", "fused", "r0", "r1")


@_query(f"WITH {_BM25_SQL}, {_DENSE_SQL}, {_RRF_SQL} SELECT query_id, rank::INTEGER AS rank, chunk_id, fused_score, bm25_score, dense_score, source AS section, replace(text, chr(10), ' ') AS text FROM hy LEFT JOIN documents ON doc_id = chunk_id")
def hybrid_search(spark, sf_dir):
    payload = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section"), "text")
    return search.hybrid(_bm25(spark, sf_dir), _dense(spark, sf_dir), payload).select("query_id", "rank", "chunk_id", "fused_score", "bm25_score", "dense_score", "section", "text")


@_query(f"WITH {_BM25_SQL}, {_DENSE_SQL} SELECT query_id, coalesce(b, 0) AS bm25_hits, coalesce(d, 0) AS dense_hits FROM (SELECT query_id, count(*) AS b FROM bm GROUP BY 1) FULL JOIN (SELECT query_id, count(*) AS d FROM dn GROUP BY 1) USING (query_id)")
def search_diagnostics(spark, sf_dir):
    return search.diagnostics(_bm25(spark, sf_dir), _dense(spark, sf_dir))


@_query(
    rf"""WITH {_BM25_SQL}, {_DENSE_SQL}, {_RRF_SQL},
    sc2 AS (SELECT hy.query_id, hy.rank AS position, hy.chunk_id, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+')) AS q, list_distinct(regexp_extract_all(lower(coalesce(d.text, '')), '[\p{{L}}\p{{N}}_]+')) AS t
            FROM hy JOIN benchmark b ON item_id = query_id LEFT JOIN documents d ON d.doc_id = chunk_id)
    SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position)::INTEGER AS rank
    FROM (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q)::DOUBLE ELSE 0.0 END AS rerank_score FROM sc2)"""
)
def rerank_overlap(spark, sf_dir):
    found = hybrid_search(spark, sf_dir).withColumn("position", F.col("rank")).join(_questions(spark, sf_dir), "query_id")
    return search.rerank(found, plugins.overlap_reranker("query", F.coalesce("text", F.lit("")))).select("query_id", "chunk_id", "rerank_score", "rank")


# Context and prompts: the turns of a conversation are its ranked results

def _turns(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.lit("conv").alias("paper_id"), F.col("role").alias("section"), "text").withColumn("rank", F.col("rank").cast("int"))


_BUDGET = 100
_PACK_SQL = f"""
o AS (SELECT conv_id, turn, role, text, greatest(1, length(text) // 4) AS est, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f(conv_id, n, used, kept) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, false FROM o
  UNION ALL SELECT o.conv_id, o.n, CASE WHEN f.used + est <= {_BUDGET} THEN f.used + est ELSE f.used END, f.used + est <= {_BUDGET} FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)"""


@_query(f"WITH RECURSIVE {_PACK_SQL} SELECT f.conv_id AS query_id, o.turn::INTEGER AS rank, est::INTEGER AS est FROM f JOIN o USING (conv_id, n) WHERE kept")
def context_pack(spark, sf_dir):
    return rag.pack_context(_turns(spark, sf_dir), _BUDGET).select("query_id", F.explode("blocks").alias("b")).select("query_id", "b.rank", "b.est")


@_query(
    f"""WITH RECURSIVE {_PACK_SQL} SELECT f.conv_id AS query_id, coalesce(string_agg('[' || conv_id || ':' || turn || '] conv — ' || role || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY turn) FILTER (kept), '') AS context
    FROM f JOIN o USING (conv_id, n) GROUP BY 1"""
)
def context_render(spark, sf_dir):
    return rag.pack_context(_turns(spark, sf_dir), _BUDGET).select("query_id", rag.render_context("blocks").alias("context"))


_STEPS_SQL = "' || chr(10) || '    ".join(rag.INSTRUCTIONS)


@_query(
    "SELECT item_id AS query_id, '" + rag.SYSTEM + "' || CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in T.MATHY_TOKENS) + f" THEN '{rag.SYSTEM_MATH}' ELSE '' END AS system, "
    f"trim('QUESTION:' || chr(10) || '    ' || text || chr(10) || chr(10) || '    CONTEXT:' || chr(10) || '    none' || chr(10) || chr(10) || '    INSTRUCTIONS:' || chr(10) || '    {_STEPS_SQL}') AS user FROM benchmark"
)
def rag_prompt(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", rag.prompt("query", F.lit("none")).alias("p")).select("query_id", "p.system", "p.user")


# Evaluation

_GOLD_SQL = "g AS (SELECT item_id AS query_id, item_id AS gold FROM benchmark), m AS (SELECT g.query_id, rank, coalesce(chunk_id = gold, false) AS hit FROM g LEFT JOIN bm USING (query_id))"


def _found(spark, sf_dir) -> DataFrame:
    gold = _questions(spark, sf_dir).select("query_id", F.col("query_id").alias("chunk_id"))
    return evaluate.matches(gold, _bm25(spark, sf_dir))


@_query(f"WITH {_BM25_SQL}, {_GOLD_SQL}, p AS (SELECT query_id, max(hit::INT) AS h, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS rr FROM m GROUP BY 1) SELECT count(*) AS queries, avg(h) AS hit_rate, avg(rr) AS mrr FROM p")
def retrieval_quality(spark, sf_dir):
    return evaluate.retrieval_quality(_found(spark, sf_dir))


@_query(f"WITH {_BM25_SQL}, {_GOLD_SQL} SELECT query_id, count(*) AS returned, count(*) FILTER (hit) AS hits FROM m GROUP BY 1")
def match_lists(spark, sf_dir):
    return evaluate.match_lists(_found(spark, sf_dir)).select("query_id", F.size("matches").cast("long").alias("returned"), F.size(F.filter("matches", lambda x: x)).cast("long").alias("hits"))


@_query("SELECT avg(quality) AS quality, avg(toxic) AS toxic FROM labels")
def judge_means(spark, sf_dir):
    return evaluate.judge_means(_t(spark, sf_dir, "labels").select(F.col("quality").cast("double"), F.col("toxic").cast("double")), ("quality", "toxic"))


@_query(
    """WITH s AS (SELECT doc_id, round(0.30 * 90 * quality + 0.25 * 80 + 0.25 * 70 + 0.10 * 60 + 0.10 * 100 * (1 - toxic)) AS overall_score FROM labels)
    SELECT doc_id, overall_score, CASE WHEN overall_score >= 90 THEN 'excellent' WHEN overall_score >= 75 THEN 'good' WHEN overall_score >= 60 THEN 'fair' WHEN overall_score >= 40 THEN 'poor' ELSE 'very_poor' END AS band FROM s"""
)
def overall_score(spark, sf_dir):
    part = _t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 90.0).alias("correctness"), F.lit(80.0).alias("coverage"), F.lit(70.0).alias("enrichment"), F.lit(60.0).alias("specificity"), ((1 - F.col("toxic")) * 100.0).alias("relevance"))
    return part.select("doc_id", evaluate.overall().alias("overall_score")).withColumn("band", evaluate.band("overall_score"))


@_query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def sample_wo_replacement(spark, sf_dir):
    return evaluate.sample(_t(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id", 7)


# Set operations, keyed records

@_query("SELECT min(doc_id) AS doc_id, md5(text) AS k FROM documents GROUP BY md5(text)")
def dedupe_keep_first(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"), (-F.col("doc_id")).alias("order"))
    return upsert.latest(d, "k", "order").select("doc_id", "k")


@_query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return upsert.latest(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def queries() -> dict:
    from . import literal_queries  # noqa: F401 - registers its own

    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {n: s for n, (_, s) in _ALL.items() if s}
