"""LaTeX cleaning: comments, dropped environments, includes, main-file choice, naive text, external converters."""

from __future__ import annotations

import posixpath
import re
import shutil
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

# What is dropped, and which suffixes an include is tried with.
DROPPED = ("figure", "figure*", "table", "table*", "tikzpicture", "axis")
SUFFIXES = ("", ".tex", ".ltx", ".tikz", ".sty")
INCLUDE = r"\\(input|include|subfile)\s*\{([^}]+)\}"
GRAPHICS = r"(?iU)\\includegraphics(?:\s*\[[^\]]*\])?\s*\{[^}]*\}"


def strip_comments(x: Column | str) -> Column:
    """Each line up to its first % without a backslash before it."""
    return F.regexp_replace(F.array_join(T.lines(x), "\n"), r"(?<!\\)%[^\n]*", "")


def naive_text(x: Column | str) -> Column:
    """Comment lines, commands and comments removed, blanks collapsed."""
    kept = F.filter(T.lines(x), lambda s: ~F.regexp_replace(s, r"(?U)^\s+", "").startswith("%"))
    t = F.regexp_replace(F.array_join(kept, "\n"), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?<!\\)%[^\n]*", ""), r"[ \t]+", " ")


def remove_environments(text: str, names=DROPPED) -> str:
    """Without the named environments, nested ones of one name matched by depth; an open one leaves the rest as it is."""
    group = "|".join(re.escape(n) for n in names)
    mark = re.compile(rf"\\(?:begin\{{(?P<b>{group})\}}(?:\[[^\]]*\])?|end\{{(?P<e>{group})\}})", re.I)
    out, at, name, depth, start = [], 0, None, 0, 0
    for m in mark.finditer(text):
        opened, closed = (m[g].lower() if m[g] else None for g in "be")
        if name is None and opened:
            out.append(text[at : m.start()])
            name, depth, start = opened, 1, m.start()
        elif name is not None and opened == name:
            depth += 1
        elif name is not None and closed == name:
            depth -= 1
            if not depth:
                name, at = None, m.end()
    out.append(text[start:] if name is not None else text[at:])
    return "".join(out)


@F.pandas_udf(StringType())
def _remove_environments(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else remove_environments(t))


def clean(x: Column | str) -> Column:
    """Depth matching is not regular: this one step runs in Python, in Arrow batches."""
    return F.regexp_replace(_remove_environments(x), GRAPHICS, "")


def main_score(path: Column | str, text: Column | str) -> Column:
    """How much a file looks like a paper's main file; -1 if it can't be read."""
    p, t = (F.col(x) if isinstance(x, str) else x for x in (path, text))
    name = F.lower(T.basename(p))
    one = lambda c, n: F.when(c, n).otherwise(0)
    score = one(F.contains(t, F.lit("\\documentclass")), 2) + one(F.contains(t, F.lit("\\begin{document}")), 3) + one(F.contains(t, F.lit("\\title")), 1) + one(name.startswith("main"), 1) + one(name.startswith("arxiv"), 1)
    return F.when(t.isNull(), -1).otherwise(score)


def main_files(files: DataFrame) -> DataFrame:
    """(paper, path, score): the best file of each paper by (score, path); none where no score is above 0."""
    best = files.groupBy("paper").agg(F.max(F.struct(main_score("path", "text").alias("score"), "path")).alias("best"))
    return best.filter("best.score > 0").select("paper", "best.path", "best.score")


def _resolve(target: str, folder: str, root: str, have) -> str | None:
    target = target.strip()
    if not target:
        return None
    bases = [target] if target.startswith("/") else [posixpath.normpath(posixpath.join(d, target)) for d in (folder, root)]
    for base in bases:
        if posixpath.splitext(base)[1]:
            if base in have:
                return base
        else:
            found = next((base + s for s in SUFFIXES if base + s in have), None)
            if found:
                return found
    return None


def inline(paths: list[str], texts: list[str], main: str, root: str = "") -> str:
    """A main file with its includes in place; each file comes in once, what isn't found vanishes."""
    have = dict(zip(paths, texts, strict=True))
    seen = {main}
    cut = re.compile(r"(?<!\\)%[^\n]*")

    def read(path: str) -> str:
        text = cut.sub("", "\n".join((have[path] or "").splitlines()))

        def put(m):
            found = _resolve(m[2], posixpath.dirname(path), root, have)
            if found is None or found in seen:
                return ""
            seen.add(found)
            return read(found)

        return re.sub(INCLUDE, put, text)

    return read(main)


def combine(files: DataFrame) -> DataFrame:
    """(paper, text): each paper's main file with its includes, cleaned; without a main file all its files in path order.

    Includes are recursive, so a paper's files meet in one call; a paper is a bounded group.
    """
    mains = main_files(files).select("paper", F.col("path").alias("main"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        paths, texts, main = pdf["path"].tolist(), pdf["text"].tolist(), pdf["main"].iloc[0]
        cut = re.compile(r"(?<!\\)%[^\n]*")
        text = inline(paths, texts, main) if isinstance(main, str) else "\n\n".join(cut.sub("", "\n".join((t or "").splitlines())) for t in texts)
        return pd.DataFrame({"paper": [pdf["paper"].iloc[0]], "text": [text]})

    got = files.join(mains, "paper", "left").groupBy("paper").applyInPandas(run, "paper string, text string")
    return got.select("paper", clean("text").alias("text"))


def convert(docs: DataFrame, text_col: str, to: str) -> DataFrame:
    """``docs`` with ``converted``, by pandoc or detex where the machine has them, else (txt) by the naive stripper; null where nothing can."""
    chain = {"md": [["pandoc", "-f", "latex", "-t", "gfm"]], "txt": [["detex"], ["pandoc", "-f", "latex", "-t", "plain"]]}[to]

    @F.pandas_udf("string")
    def external(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            for cmd in (c for c in chain if shutil.which(c[0])):
                with tempfile.TemporaryDirectory() as d:
                    f = Path(d, "in.tex")
                    f.write_text(text)
                    done = subprocess.run([*cmd, str(f)], capture_output=True)
                    if done.returncode == 0:
                        return done.stdout.decode("utf-8", "ignore")
            return None

        return s.map(one)

    got = docs.withColumn("converted", external(text_col))
    return got.withColumn("converted", F.coalesce("converted", F.when(F.col(text_col).isNotNull(), naive_text(text_col)))) if to == "txt" else got
