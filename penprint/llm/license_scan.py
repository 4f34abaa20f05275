"""Licence scans: sparse TF-IDF cosine against templates, then inheritance from the nearest ancestor directory.

Every paragraph of a file that has a word of licences is compared as a whole, by its lines and pairs of lines with such a word, and by
every stretch of as many words as a template (a *header*): its sparse TF-IDF vector with the templates', by an inverted index of their terms.
White space of any kind counts as one blank. The best cosine at the threshold or above, if a naming word
of the template is there too, is the file's own licence. A *licence file* is one whose name says so (LICENSE, COPYING, ...) or
whose text is mostly licence; it speaks for its directory. Files without a licence of their own inherit from the nearest
ancestor directory that has a licence file: distinct directories meet their ancestors in equi-joins on the path, and
files then meet their directory.

Defined cases: null texts are empty and null paths are the root; ``.`` and empty path parts are left out; the best score
wins, ties go to the first template by id; several licence files of one directory: the highest score, then the least
licence id. Rows that repeat get equal results. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, lots

THRESHOLD, MOSTLY = 0.55, 0.5
#: Directories with a licence above this many are joined by shuffle.
BROADCAST_DIRECTORIES = 200_000

#: id: (family, naming patterns of which one must occur, texts)
TEMPLATES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "Apache-2.0": ("permissive", r"\bapache\b", ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0")),
    "MIT": ("permissive", r"\bmit\b|permission is hereby granted, free of charge", ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT")),
    "BSD-3-Clause": ("permissive", r"\bbsd\b|redistribution and use in source and binary forms", ("Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause")),
    "GPL-3.0": ("copyleft", r"\b(?:gnu|gpl)", ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only")),
    "MPL-2.0": ("copyleft", r"\b(?:mozilla|mpl)\b", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0")),
    "CC-BY-4.0": ("attribution", r"\bcc[ -]by[ -]4|creative commons attribution 4", ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0")),
    "CC-BY-SA-4.0": ("copyleft", r"\bcc[ -]by[ -]sa|attribution[ -]share-?alike", ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0")),
    "CC-BY-NC-4.0": ("noncommercial", r"\bcc[ -]by[ -]nc\b(?!-[sn])|attribution[ -]non-?commercial", ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0")),
    "CC0-1.0": ("public", r"\bcc0\b|public domain", ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0")),
    "Proprietary": ("proprietary", r"all rights reserved", ("Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission.")),
}
_CUE = re.compile(r"licen[cs]|spdx|all\s+rights\s+reserved|public\s+domain|\bcc0\b|\bcc[\s-]by\b|permission\s+is\s+hereby|redistribution\s+and\s+use", re.I)
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_FILE = re.compile(r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[.\-_].*)?$")


def terms(text: str) -> list[str]:
    found = _TERM.findall(text.lower())
    return found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


class Templates:
    """An inverted index of the templates' TF-IDF vectors; a term's rarity is its rarity among templates."""

    def __init__(self, templates: dict[str, tuple[str, str, tuple[str, ...]]]):
        self.names = sorted(templates)
        self.naming = {k: re.compile(templates[k][1], re.I) for k in self.names}
        self.family = {k: templates[k][0] for k in self.names}
        texts = [(k, Counter(terms(t))) for k in self.names for t in templates[k][2]]
        df = Counter(t for _, c in texts for t in c)
        self.idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
        self.rare = math.log(1 + len(texts)) + 1
        self.posts: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.owner = [k for k, _ in texts]
        self.words = [sum(n for t, n in c.items() if " " not in t) for _, c in texts]
        for i, (_, c) in enumerate(texts):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.posts[t].append((i, n * self.idf[t] / norm))

    def best(self, text: str) -> tuple[float, str] | None:
        """The licence of greatest cosine whose name is in the text."""
        c = Counter(terms(text))
        dots: dict[int, float] = defaultdict(float)
        square = 0.0
        for t, n in c.items():
            w = n * self.idf.get(t, self.rare)
            square += w * w
            for i, x in self.posts.get(t, ()):
                dots[i] += w * x
        ranked = sorted((-d / math.sqrt(square), self.owner[i]) for i, d in dots.items())
        plain = " ".join(text.split())
        return next(((-d, k) for d, k in ranked if self.naming[k].search(plain)), None)

    def windows(self, text: str, threshold: float) -> Iterator[str]:
        """Of all stretches with as many words as a template, those whose cosine with it may reach the threshold.

        A stretch's product with a template is a sum over its terms. Its norm is at least the root of the sum of its terms' squared
        weights (more where a term repeats), so running sums bound every cosine from above.
        """
        text = text.lower()
        at = [(m.start(), m.end()) for m in _TERM.finditer(text)]
        found = [text[a:b] for a, b in at]
        # terms by their last word: for the first word of a stretch, its pair with the word before doesn't count
        singles, pairs = found, ["", *[f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]]
        weigh = lambda terms_of: np.array([self.idf.get(t, self.rare) for t in terms_of])
        one, two = weigh(singles), weigh(pairs)
        gains: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for kind, terms_of in enumerate((singles, pairs)):
            for place, t in enumerate(terms_of):
                for i, x in self.posts.get(t, ()):
                    gains[i][kind].append((place, self.idf[t] * x))
        sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        norms = sums(one * one), sums(two * two)
        for i, both in gains.items():
            n = min(self.words[i], len(found))
            dots = []
            for of in both:
                dense = np.zeros(len(found))
                for place, x in of:
                    dense[place] = x
                dots.append(sums(dense))
            within = lambda s: (s[0][n:] - s[0][:-n]) + (s[1][n:] - s[1][1:len(found) - n + 2])  # noqa: E731, B023
            for k in np.flatnonzero(within(dots) >= (threshold - 1e-9) * np.sqrt(within(norms))).tolist():
                yield text[at[k][0]:at[k + n - 1][1]]


def scan_text(index: Templates, text: str, threshold: float) -> tuple[str | None, float | None, float]:
    """(licence, score, share of the text's words in licence headers)."""
    best: tuple[float, str] | None = None
    inside = total = 0
    if _CUE.search(text):
        for paragraph in re.split(r"\n\s*\n", text):
            lines = [x for x in paragraph.split("\n") if x.strip()]
            if not _CUE.search(paragraph):
                continue
            hits = [bool(_CUE.search(x)) for x in lines]
            spans = {paragraph, *index.windows(paragraph, threshold)}
            for i, hit in enumerate(hits):
                if hit:
                    spans |= {lines[i], " ".join(lines[i:i + 2]), " ".join(lines[max(0, i - 1):i + 1])}
                    # a sentence inside a long line
                    spans |= {x for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", lines[i]) if _CUE.search(x)}
            own, longest = None, 0
            for span in sorted(spans):
                got = index.best(span)
                if got and got[0] >= threshold:
                    longest = max(longest, len(span.split()))
                    if own is None or (-got[0], got[1]) < (-own[0], own[1]):
                        own = got
            if own:
                inside += longest
                if best is None or (-own[0], own[1]) < (-best[0], best[1]):
                    best = own
        total = len(text.split())
    return (best[1], round(best[0], 6), min(1.0, inside / max(1, total))) if best else (None, None, 0.0)


def path_parts(path: Column) -> Column:
    """The parts of a path, without empty ones and ``.``."""
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: (x != "") & (x != "."))


def scan_licenses(files: DataFrame, templates: dict | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``doc_id, path, license, family, score, origin, license_dir`` for every row.

    ``origin`` is ``file`` (a licence file), ``header``, ``inherited``, or null without any licence.
    """
    spark = files.sparkSession
    table = templates or TEMPLATES

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(table)
        for batch in lots(batches):
            out = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                license_id, score, share = scan_text(index, text or "", threshold)
                out.append((license_id, score, bool(license_id) and (share >= MOSTLY or bool(_FILE.match(name or "")))))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "path", "dir")), pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.float64()), pa.array(list(cols[2]), pa.bool_())], ["doc_id", "path", "dir", "license", "score", "speaks"])

    parts = path_parts(F.col(path_col).cast("string"))
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), parts.alias("parts"), F.col(text_col).cast("string").alias("text"))
    last = F.try_element_at("parts", F.lit(-1))
    rows = rows.select("doc_id", "path", F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/").alias("dir"), last.alias("name"), "text")
    own, own_path = kept(rows.mapInArrow(scanned, f"doc_id {kind}, path string, dir string, license string, score double, speaks boolean"))
    # the best score, of equal scores the least licence
    speaking = own.where("speaks").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("worse"), "license")).alias("s"))
    speaking = speaking.select("dir", F.col("s.license").alias("d_license"), (-F.col("s.worse")).alias("d_score"))
    speaking, speaking_path = kept(speaking)
    # each directory once, with all its ancestors; the deepest that speaks
    dirs = own.select("dir").distinct().withColumn("p", F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/")))
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("above"))
    small = speaking.limit(BROADCAST_DIRECTORIES + 1).count() <= BROADCAST_DIRECTORIES
    speaks = speaking.withColumnRenamed("dir", "above")
    nearest = up.join(F.broadcast(speaks) if small else speaks, "above").groupBy("dir").agg(F.max_by(F.struct("above", "d_license", "d_score"), F.length("above")).alias("n"))
    nearest, nearest_path = kept(nearest)
    near = F.broadcast(nearest) if nearest.limit(BROADCAST_DIRECTORIES + 1).count() <= BROADCAST_DIRECTORIES else nearest
    family = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, v[0])])
    license_id = F.coalesce("license", "n.d_license")
    out = own.join(near, "dir", "left").select(
        "doc_id", "path", license_id.alias("license"), F.try_element_at(family, license_id).alias("family"), F.coalesce("score", "n.d_score").alias("score"),
        F.when(F.col("speaks"), "file").when(F.col("license").isNotNull(), "header").when(F.col("n").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("dir")).otherwise(F.col("n.above")).alias("license_dir"))
    out, _ = kept(out)
    dropped(spark, own_path, speaking_path, nearest_path)
    return out
