"""Chunkers against small imperative models, and the invariants of packing and linking."""

import random
import re

from docquarry.operators import chunk_md, chunk_txt


def model_pack(lengths, gap, first_gap):
    cuts, n, size = [], 0, 0
    for i, length in enumerate(lengths):
        add = length + (gap if n else first_gap)
        if n and ((size + add > 1800 and size >= 200) or size + add > 2400):
            n, size, add = 0, 0, length + first_gap
        if not n:
            cuts.append(i)
        n, size = n + 1, size + add
    return cuts


def model_split(text, most=1800):
    text = " ".join(text.split())
    if len(text) <= most:
        return [text] if text else []

    def pack(parts):
        out, now = [], ""
        for p in parts:
            if now and len(now) + 1 + len(p) > most:
                out.append(now)
                now = p
            else:
                now = f"{now} {p}" if now else p
        return out + [now] * bool(now)

    return [w for s in pack(re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text)) for w in (pack(s.split(" ")) if len(s) > most else [s])]


SECTION = re.compile(r"^\s*(?:\d+(?:\.\d+)*)?\s*(abstract|introduction|preliminaries|related work|results|proofs?|conclusion|acknowledg(?:e)?ments?|references?)\s*:??\s*$", re.I)


def model_txt(stem, text):
    items, run = [], []
    for n, line in enumerate([*text.splitlines(), ""], 1):
        if line.strip():
            run.append((n, line.strip()))
        elif run:
            body = "\n".join(s for _, s in run)
            if len(re.sub("[^0-9A-Za-z]", "", body)) > 2 or " " in body:
                m = SECTION.match(run[0][1])
                for seg in model_split(body) if len(body) > 2400 else [body]:
                    items.append((run[0][0], run[-1][0], seg, m[1].title() if m else ""))
            run = []
    cuts, out, section = model_pack([len(i[2]) for i in items], 2, 0), [], ""
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(items)], strict=False)):
        own = items[a:b]
        section = next((i[3] for i in reversed(own) if i[3]), section)
        parts = [items[a - 1][2]] * bool(a and items[a - 1][2].strip()) + [i[2] for i in own]
        out.append((f"{stem}::L{own[0][0]}-{own[-1][1]}::c{k}", section, "\n\n".join(parts).strip()))
    return out


def texts():
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["alpha", "beta.", "Gamma", "delta!", "9", "x"]) for _ in range(n))
    rows = {
        "paras": "one two\n\n--\n\n.\n\nab\n\nabc\n\x0c\nlast line\r\nof para more",
        "long": words(900) + "\n\n" + "y" * 2000 + " " + words(800) + "\n\nAbstract\n\nshort",
        "sections": "Abstract\n" + words(300) + "\n\n" + words(280) + "\n\n1.2 Introduction:\n\n" + words(350) + "\n\n" + words(20),
        "empty": "", "blank": " \n\n ", "one": "z",
    }
    for k in range(12):
        rows[f"r{k}"] = "\n\n".join(words(rng.choice([1, 5, 30, 120, 300, 420])) for _ in range(rng.randint(1, 14)))
    return rows


def test_txt_chunks_equal_the_model(spark):
    rows = texts()
    df = spark.createDataFrame([(f"/d/{k}.txt", t) for k, t in rows.items()], "file string, text string")
    got = {}
    for r in chunk_txt.chunk(df).orderBy("file", "idx").collect():
        got.setdefault(r["file"][3:-4], []).append((r["id"], r["section"], r["text"]))
    assert got == {k: m for k, t in rows.items() if (m := model_txt(k, t))}


def test_txt_neighbours_and_records(spark):
    df = spark.createDataFrame([(f"/d/{k}.txt", t) for k, t in texts().items()], "file string, text string")
    rows = chunk_txt.normalise(chunk_txt.chunk(df), clock=5).collect()
    n = {r["chunk_id"]: {x["direction"]: x["id"] for x in r["neighbors"]} for r in rows}
    for i, links in n.items():
        if "next" in links:
            assert n[links["next"]]["previous"] == i
    for r in rows:
        assert r["text_len"] == len(r["text"]) > 0 and r["section"] and r["added_at"] == 5 and r["version"] == "pptxt-0.1" and r["meta"]["source_kind"] == "plain_text"


MD = r"""pre one

pre two
# One
a

```
# not a heading

still
```
$$
# nor this
$$
### Deep
b $$x\label{e1}$$
### Deeper
see \ref{e1} and \eqref{e2}
## Two
$$x$$
# swallowed
$$
c \label{e2} \ref{e2} \ref{gone}
#foo bar
end"""


def md(spark, *texts_):
    return spark.createDataFrame([(f"/d/m{k}.md", t) for k, t in enumerate(texts_)], "file string, text string")


def test_md_sections(spark):
    (d,) = chunk_md.sections(md(spark, MD)).collect()
    got = [(s["level"], s["title"], s["path"]) for s in d["sections"]]
    assert got == [(0, "", ""), (1, "One", "One"), (3, "Deep", "One / Deep"), (3, "Deeper", "One / Deep / Deeper"), (2, "Two", "One / Two"), (4, "bar", "One / Two / bar")]
    assert d["sections"][0]["start"] == 1 and d["sections"][-1]["end"] == len(MD.splitlines())


def test_md_packing(spark):
    parts = ["p" * 150, "q" * 1700, "r" * 2500, "", "s" * 300, "t" * 1600, "u" * 100]
    rows = chunk_md.chunk(md(spark, "\n\n".join(parts))).orderBy("pos").collect()
    lines, paras, start = "\n\n".join(parts).splitlines(), [], 1
    for n, line in enumerate(lines, 1):
        if not line.strip():
            paras.append((start, n, "\n".join(lines[start - 1 : n]).rstrip()))
            start = n + 1
    if start <= len(lines):
        paras.append((start, len(lines), "\n".join(lines[start - 1 :]).rstrip()))
    cuts = model_pack([len(p[2]) for p in paras], 1, 1)
    want = []
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(paras)], strict=False)):
        carry = [paras[a - 1][2]] if a and paras[a - 1][2].strip() else []
        want.append((f"m0::L{paras[a][0]}-{paras[b - 1][1]}::s{k}", "\n\n".join(carry + [p[2] for p in paras[a:b]]).strip()))
    assert [(r["id"], r["text"]) for r in rows] == want


def test_md_links(spark):
    rows = chunk_md.link(chunk_md.chunk(md(spark, MD, "# other\n\\label{e1}"))).orderBy("file", "pos").collect()
    by = {r["id"]: [(n["id"], n["direction"]) for n in r["neighbors"]] for r in rows}
    ids = [r["id"] for r in rows if r["file"] == "/d/m0.md"]
    src = next(r["id"] for r in rows if r["refs"] == ["e1", "e2"])
    held = {x: next(r["id"] for r in rows if x in r["labels"] and r["file"] == "/d/m0.md") for x in ("e1", "e2")}
    k = ids.index(src)
    assert by[src] == [(ids[k - 1], "previous"), (ids[k + 1], "next"), (held["e1"], "reference"), (held["e2"], "reference")]
    assert (src, "comment") in by[held["e1"]] and (src, "comment") in by[held["e2"]]
    other = next(r for r in rows if r["file"] == "/d/m1.md")
    assert not other["neighbors"]
    final = chunk_md.normalise(spark.createDataFrame(rows)).collect()
    assert all(r["text"] and r["version"] == "ppmdc-0.1" for r in final)


def test_html(spark):
    df = spark.createDataFrame([(1, "<head><title>t</title></head><h1>Top</h1><script>x</script><p>one <b>two</b></p><h2>Sub</h2><p>a &amp; b</p>")], "page_id long, html string")
    assert chunk_md.html_to_markdown(df).first()["text"] == "# Top\n\none two\n\n## Sub\n\na & b"
