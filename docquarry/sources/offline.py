"""A catalogue without a network: canned entries, served in pages like the real one."""

from __future__ import annotations

#: (entry id, title, category, authors, published, updated)
ENTRIES = [(f"http://arxiv.org/abs/2401.{1000 + k}v{1 + k % 3}", f" Title {k} ", ("math-ph", "math.SP")[k % 2], [f"A{k}", f"B{k % 7}"], f"2024-01-{1 + k % 28:02d}", None if k % 4 else "2024-06-01") for k in range(130)]
_CITING = {k: [f"2401.{1000 + (k + 1) % 130}", None, f"2401.{1000 + (k + 2) % 130}"] for k in range(0, 130, 5)}


def fetch(query: str, offset: int, limit: int) -> list[tuple]:
    """Entries [offset, offset + limit) of those whose category the query names."""
    found = [e for e in ENTRIES if f"cat:{e[2]}" in query]
    return [(i, t, c, [c], [{"name": a} for a in authors], published, updated, "about " + t.strip(), None) for i, t, c, authors, published, updated in found[offset : offset + limit]]


def citations(base_id: str) -> list[dict]:
    """Records of the papers that cite one; an id may be missing."""
    k = int(base_id.split(".")[1]) - 1000
    return [{"citedPaper": None, "citingPaper": {"externalIds": {"ArXiv": x}}} for x in _CITING.get(k, [])]


def archive(candidate: str) -> bytes | None:
    """The source of a paper by one of its candidate names; every ninth has none."""
    k = int(candidate.split("v")[0].split(".")[1]) - 1000
    return None if k % 9 == 0 else f"\\documentclass{{article}}\n\\begin{{document}}\nText of {k}. % note\n\\end{{document}}\n".encode()
