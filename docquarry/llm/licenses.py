"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. Document frequencies of the templates' terms are counted over all files. A term outside the templates weighs as one
   that no file has, so foreign words around a notice lower its cosine.
2. Every window of a template's length in tokens is compared with it, wherever lines break. Bounds on the cosine skip
   templates and windows without losing a match. Of a short notice the names and versions (``_marks``) must agree, since
   the notices of GPL versions or Creative Commons kinds differ in little else; of a long text (``LONG`` tokens) half of
   the five-word sequences must be there, since any English text shares its frequent words.
3. A file that is named like a licence file, or is nothing but a licence's full text, licenses its directory. A file without a notice
   of its own inherits from the nearest such directory above it: its ancestors meet the licensed directories in an
   equi-join, the deepest one stays.

Nulls: a null text is empty; a null path has no directory and inherits nothing. Of several best templates the first by
name counts; of several licence files in a directory the best score, then the first path. Repeated rows each get a
result. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files as packaged

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import result, scratch, stage, table

THRESHOLD, WHOLE, LONG = 0.75, 0.9, 80
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"GPL": ("", "program", ("1", "2", "3")), "LGPL": ("Lesser ", "library", ("2.1", "3")), "AGPL": ("Affero ", "program", ("3",))}


def _cc(kind: str, version: str, area: str) -> tuple[str, ...]:
    return f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {_CC[kind]} {version} {area} License."


def _gnu(name: str, thing: str, version: str) -> tuple[str, ...]:
    long = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, "
    return f"This work is licensed under the GNU {name}General Public License, version {version}.", long + f"either version {version} of the License, or (at your option) any later version.", long + f"version {version} of the License."


#: The usual notices of common licences.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "Apache-2.0 OR MIT": ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "ISC": ("Licensed under the ISC License.",),
    "LGPL-2.0": _gnu("Library ", "library", "2"),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": ("All rights reserved.",),
}
NOTICES |= {f"CC-{k}-{v}": _cc(k, v, area) for k in _CC for v, area in (("4.0", "International"), ("3.0", "Unported"))}
NOTICES |= {f"{k}-{v if '.' in v else v + '.0'}": _gnu(name, thing, v) for k, (name, thing, versions) in _GNU.items() for v in versions}

#: Full texts, by name; a licence without a file here (AGPL, most of Creative Commons) is known by its notices only.
FULL = {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in sorted(packaged(__package__).joinpath("licence_texts").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}
TEMPLATES = {name: (*NOTICES.get(name, ()), *((FULL[name],) if name in FULL else ())) for name in sorted({*NOTICES, *FULL})}

_NAMES = frozenset("lesser affero sharealike sa noncommercial nc noderivatives nd mit bsd apache gnu mozilla isc gpl lgpl agpl mpl clause".split())
_version = re.compile(r"\b(?:version|v|by|sa|nc|nd|license|licence|attribution|sharealike|noncommercial|noderivatives|bsd) ([0-9])(?: ([0-9]))?\b")


def _marks(tokens: list[str]) -> frozenset[str]:
    """What tells similar notices apart: names, kinds and versions."""
    text = " ".join(tokens)
    found = {a if b in ("", "0") else f"{a}.{b}" for a, b in _version.findall(text)}
    return frozenset(found | _NAMES.intersection(tokens) | ({"library general"} if "library general" in text else set()))


_terms = re.compile(r"[a-z0-9]+")


def terms(text: str) -> list[str]:
    return _terms.findall(text.lower())


def document_frequencies(files: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Number of files, and how many of them have each template term (as many rows as there are such terms)."""
    wanted = frozenset(t for texts in TEMPLATES.values() for x in texts for t in terms(x))

    def run(batches):
        n, df = 0, Counter()
        for b in batches:
            n += b.num_rows
            for x in b.column(0):
                df.update(wanted.intersection(_terms.findall((x.as_py() or "").lower())))
        rows = [("", n), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    with scratch(files.sparkSession):
        found = stage(files.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "license-terms")
        got = {r["term"]: r["n"] for r in found.collect()}
    return got.pop("", 0), got


def _sequences(tokens: list[str], n: int = 5) -> set[tuple]:
    return set(zip(*(tokens[k:] for k in range(n)), strict=False))


class Templates:
    """TF-IDF vectors of the templates."""

    def __init__(self, n: int, df: dict[str, int], threshold: float):
        self.threshold = threshold
        self.foreign = math.log(n + 1) + 1
        self.names, words, self.full = [], [], []
        for name, texts in sorted(TEMPLATES.items()):
            for text in texts:
                self.names.append(name)
                words.append(terms(text))
                self.full.append(text is FULL.get(name))
        self.number = {t: k for k, t in enumerate(sorted({t for x in words for t in x}))}
        self.idf = np.array([math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in self.number] + [self.foreign])
        self.lengths = [len(x) for x in words]
        self.vectors = np.zeros((len(self.number) + 1, len(words)))  # the last row is for terms outside the templates
        for k, x in enumerate(words):
            for t, c in Counter(x).items():
                self.vectors[self.number[t], k] = c * self.idf[self.number[t]]
        self.vectors /= np.sqrt((self.vectors**2).sum(0))
        self.squares = self.vectors**2
        self.marks = [_marks(x) if len(x) < LONG else None for x in words]
        self.sequences = [_sequences(x) if len(x) >= LONG else None for x in words]
        self.tiny = [frozenset(x) if len(x) <= 3 else frozenset() for x in words]

    def _windows(self, ids: np.ndarray, rows: np.ndarray, k: int, weight: np.ndarray, squares: np.ndarray):
        """(score, start, end) of the windows of template ``k`` that reach the threshold."""
        length = min(self.lengths[k], len(ids))
        dots = np.concatenate(([0.0], np.cumsum(self.vectors[rows, k] * weight)))
        dots = dots[length:] - dots[:-length]
        # a window's norm is at least that of its tokens counted once each
        hopeful = np.flatnonzero(dots >= (self.threshold - 1e-9) * np.sqrt(squares[length:] - squares[:-length]))
        counts: Counter = Counter()
        norm, last = 0.0, -2
        ids_, w2 = ids.tolist(), (weight**2).tolist()
        for s in hopeful.tolist():
            if s != last + 1:
                counts, norm = Counter(), 0.0
                for j in range(s, s + length):
                    norm += w2[j] * (2 * counts[ids_[j]] + 1)
                    counts[ids_[j]] += 1
            else:
                out, new = s - 1, s + length - 1
                norm -= w2[out] * (2 * counts[ids_[out]] - 1)
                counts[ids_[out]] -= 1
                norm += w2[new] * (2 * counts[ids_[new]] + 1)
                counts[ids_[new]] += 1
            last = s
            score = float(dots[s]) / math.sqrt(max(norm, 1e-12))
            if score >= self.threshold:
                yield score, s, s + length

    def scan(self, text: str) -> tuple[float, str | None, float]:
        """Best score and licence over all windows (0 and None below the threshold), and the whole text's to a full text."""
        words = terms(text)
        known = self.number
        own = [known[t] for t in set(words) if t in known]
        # Cauchy-Schwarz: no window exceeds what the template has in common with the file
        reach = np.flatnonzero(self.squares[own].sum(0) >= 0.999 * self.threshold**2) if own else ()
        if not len(reach):
            return 0.0, None, 0.0
        table_ = {t: k for k, t in enumerate(sorted(set(words).difference(known)), len(known))}
        ids = np.array([known[t] if t in known else table_[t] for t in words])
        weight = self.idf[np.minimum(ids, len(known))]
        squares = np.concatenate(([0.0], np.cumsum(weight**2)))
        rows = np.minimum(ids, len(known))
        best: tuple = (False, 0.0, 0, None)
        whole, sequences = 0.0, None
        for k in reach.tolist():
            if self.sequences[k] is not None:
                sequences = _sequences(words) if sequences is None else sequences
                if 2 * len(self.sequences[k] & sequences) < len(self.sequences[k]):
                    continue
            for score, s, e in self._windows(ids, rows, k, weight, squares):
                rank = (self.names[k] != "Proprietary", round(score, 9), self.lengths[k])
                if rank <= best[:3]:
                    continue
                window = words[s:e]
                if self.marks[k] is not None and (_marks(window) != self.marks[k] or not self.tiny[k] <= set(window)):
                    continue
                best = (*rank, self.names[k])
            if self.full[k]:
                norm = math.sqrt(sum(c * c * float(self.idf[min(i, len(known))]) ** 2 for i, c in Counter(ids.tolist()).items()))
                whole = max(whole, float((self.vectors[rows, k] * weight).sum()) / norm)
        return best[1], best[3], whole


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: file_id, path, license, score, origin (own, inherited, none), license_path."""
    with scratch(files.sparkSession):
        return result(_scanned(files, id_col, path_col, text_col, threshold), "licenses")


def _scanned(files: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float) -> DataFrame:
    n, df = document_frequencies(files, text_col)
    templates = Templates(n, df, threshold)
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [templates.scan(x.as_py() or "") for x in b.column(2)]
            own = [g if g[0] >= threshold else (g[0], None, g[2]) for g in got]
            cols = [b.column(0), b.column(1), pa.array([g[1] for g in own], pa.string()), pa.array([g[0] for g in own], pa.float64()), pa.array([g[2] >= WHOLE for g in own], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["file_id", "path", "license", "score", "whole"])

    scanned = files.select(F.col(id_col), F.col(path_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, f"file_id {kind}, path string, license string, score double, whole boolean")
    scanned = stage(scanned, "license-scan")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    licensing = scanned.filter(F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("whole") | F.col("path").rlike(LICENCE_FILE)))
    # of a directory's licence files: greatest score, then first path, then first name
    dirs = licensing.groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("d"))
    dirs = stage(dirs.select("dir", F.col("d.path").alias("license_path"), F.col("d.license").alias("dir_license")), "license-dirs")
    bare = scanned.filter("license IS NULL AND path IS NOT NULL").select("path").distinct()
    parts = F.split(folder, "/")
    above = bare.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("dir", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = above.join(dirs, "dir").groupBy("path").agg(F.max(F.struct("depth", "license_path", "dir_license")).alias("d")).select("path", "d.license_path", "d.dir_license")
    out = scanned.join(nearest, "path", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("file_id", "path", F.coalesce("license", "dir_license").alias("license"), "score", origin.alias("origin"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("license_path")).alias("license_path"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source and the id's thousands are their directories."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 1000 AS string)"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = scan_licenses(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")
    return found.withColumnRenamed("file_id", "doc_id")
