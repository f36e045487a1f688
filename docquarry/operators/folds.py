"""Sequential folds over a document's lines, for Arrow batches: each document is folded where it lies, nothing is shuffled.

The fence state machine and the greedy packings carry state from line to line; as nested lambdas of Catalyst they are
interpreted and cost minutes where these take seconds (figures in the README).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.text import SECTION as TEXT_SECTION

MAX, HARD, MIN = 1800, 2400, 200
SECTION = re.compile(TEXT_SECTION.replace("(?iU)^", "(?i)").replace("$", r"\Z"))
_sentence = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def greedy(lengths: list[int], gap: int, lead: int) -> list[tuple[int, int]]:
    """[first, end) of each chunk. An item adds its length and ``gap``, the first of a chunk ``lead`` instead."""
    out, first, size = [], 0, 0
    for i, n in enumerate(lengths):
        grown = size + n + gap
        if i > first and (grown > HARD or (grown > MAX and size >= MIN)):
            out.append((first, i))
            first, size = i, n + lead
        else:
            size = grown if i > first else n + lead
    if lengths:
        out.append((first, len(lengths)))
    return out


def fill(parts: list[str], most: int) -> list[str]:
    """Parts joined by spaces up to ``most`` characters; longer parts stay whole."""
    rows: list[list[str]] = []
    size = 0
    for p in parts:
        if rows and size + 1 + len(p) <= most:
            rows[-1].append(p)
            size += 1 + len(p)
        else:
            rows.append([p])
            size = len(p)
    return [" ".join(r) for r in rows]


def segments(text: str, most: int = MAX) -> list[str]:
    flat = " ".join(text.split())
    if len(flat) <= most:
        return [flat] if flat else []
    return [s for row in fill(_sentence.split(flat), most) for s in (fill(row.split(" "), most) if len(row) > most else [row])]


def _join(carry: str, parts: list[str]) -> str:
    return "\n\n".join([carry, *parts] if carry.strip() else parts).strip()


def paragraphs(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(first line, last line, text, section name): runs of non-blank lines that hold more than two letters or a space."""
    lines, n = [x.strip() for x in text.splitlines()], 0
    while n < len(lines):
        end = n
        while end < len(lines) and lines[end]:
            end += 1
        if end > n:
            body = "\n".join(lines[n:end])
            if " " in body or len(re.sub("[^0-9A-Za-z]+", "", body)) > 2:
                named = SECTION.match(lines[n])
                yield n + 1, end, body, named[1].strip().title() if named else ""
        n = end + 1


def text_items(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, text, section name) of every paragraph, long ones in segments."""
    return [(a, b, s, hint) for a, b, body, hint in paragraphs(text) for s in (segments(body) if len(body) > HARD else [body])]


def text_chunks(text: str) -> Iterator[tuple[int, str, int, int, str]]:
    """(idx, section, start_line, end_line, text)."""
    items, section = text_items(text), ""
    for k, (a, b) in enumerate(greedy([len(i[2]) for i in items], 2, 0)):
        section = next((i[3] for i in reversed(items[a:b]) if i[3]), section)
        yield k, section, items[a][0], items[b - 1][1], _join(items[a - 1][2] if a else "", [i[2] for i in items[a:b]])


def markdown_lines(text: str) -> Iterator[tuple[int, str, str]]:
    """(number, line, what): what is "heading", "blank" (ends a paragraph) or "text"; fences and display maths hold text only."""
    state = ""
    for n, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        fence = next((f for f in ("```", "$$") if bare.startswith(f)), "")
        if fence and state in ("", fence):
            state = "" if state else fence
            yield n, line, "text"
        elif state:
            yield n, line, "text"
        else:
            yield n, line, "blank" if not bare else "heading" if bare.startswith("#") else "text"


def markdown_sections(text: str) -> Iterator[tuple[int, str, str, list]]:
    """(level, title, path, paragraphs); a paragraph is (first line, last line, text) and ends with its blank line."""
    stack: list[str] = []
    head: tuple[int, str, str] = (0, "", "")
    paras: list[tuple[int, int, str]] = []
    held: list[str] = []
    first, last = 1, 0

    def close():
        if held:
            paras.append((first, last, "\n".join(held).rstrip()))

    for n, line, what in markdown_lines(text):
        if what == "heading":
            close()
            if paras:
                yield *head, paras
            bare = line.lstrip()
            level, title = len(bare.split(None, 1)[0]), bare.partition(" ")[2]
            stack = [*stack[: level - 1], title]
            head, paras, held, first = (level, title, " / ".join(s for t in stack if (s := t.strip()))), [], [], n
        held.append(line)
        last = n
        if what == "blank":
            close()
            held, first = [], n + 1
    close()
    if paras:
        yield *head, paras


def markdown_chunks(text: str) -> Iterator[tuple[int, str, int, str, int, int, str]]:
    """(idx within its section, section_path, level, title, start_line, end_line, text)."""
    for level, title, path, paras in markdown_sections(text):
        for k, (a, b) in enumerate(greedy([len(p[2]) for p in paras], 1, 1)):
            yield k, path, level, title, paras[a][0], paras[b - 1][1], _join(paras[a - 1][2] if a else "", [p[2] for p in paras[a:b]])
