"""Licence scans by patience alignment of texts and licence templates.

Words are runs of letters and digits (``2.0`` is one word), lower-cased.  A template
is aligned with a stretch of text by patience: words that occur once in both are
anchors, the longest increasing subsequence of their positions is kept, and the gaps
between kept anchors are aligned in the same way; equal words at the ends of a gap are
matched first.  Coverage is the share of the template's words that are matched.

Stretches come from telling words: words of a template with six letters or more, or
with a digit or capitals only, that are not common words.  Each occurrence predicts
where the template would begin; a stretch of the template's length and a quarter more
is aligned there.  Telling words already inside a match begin no new stretch, so a
line that repeats is found each time.  Where matches of several templates overlap, the
one with the most matched words stays, then the one of greater coverage.

Whole texts are scanned in one pass without a shuffle; templates are a small fixed set.

Defined results: a null or empty text has no matches; repeated rows and null ids each
give their matches; a template whose words all repeat is matched by its ends only; an
empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from streamlearn.llm.common import read, slices

#: Least coverage of a template, and least share of matched words within the matched stretch.
COVERAGE, DENSITY = 0.8, 0.6

#: The licence notices looked for.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT line": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "BSD notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
}
_COMMON = frozenset("the and for with this that from have not are was you any all under without following either person subject including "
                    "provided published required person persons program conditions either".split())
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


# ----------------------------------------------------------------- alignment
def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, increasing in both, of pairs sorted by the first."""
    tops, last, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing in both."""
    matched, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, i2, j, j2 = stack.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            matched.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            matched.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once: dict[str, int] = {}
        for k in range(i, i2):
            once[a[k]] = -1 if a[k] in once else k
        there: dict[str, int] = {}
        for k in range(j, j2):
            if once.get(b[k], -1) >= 0:
                there[b[k]] = -1 if b[k] in there else k
        anchors = _increasing(sorted((once[w], k) for w, k in there.items() if k >= 0))
        if not anchors:
            continue
        matched += anchors
        ends = [(i - 1, j - 1), *anchors, (i2, j2)]
        stack += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
    return sorted(matched)


def densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of matched pairs with the largest number of pairs less unmatched words of the text between them (the first
    and shortest such run): a few last words that were matched only in a next copy, far behind, fall off."""
    best, score, start, top = (0, 1), 1, 0, 1
    for k in range(1, len(pairs)):
        score += 1 - (pairs[k][0] - pairs[k - 1][0] - 1)
        if score < 1:
            score, start = 1, k
        if score > top:
            best, top = (start, k + 1), score
    return pairs[best[0]:best[1]]


@dataclasses.dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    matched: int
    first: int            # words of the text
    last: int


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY):
        self.templates = [(name, words_of(t)) for name, t in templates.items()]
        self.coverage, self.density = coverage, density
        self.telling: dict[str, list[tuple[int, int]]] = {}
        for n, (name, words) in enumerate(self.templates):
            raw = _WORD.findall(templates[name])
            for k, w in enumerate(words):
                if words.count(w) == 1 and w not in _COMMON and (len(w) >= 6 or any(c.isdigit() for c in w) or raw[k].isupper()):
                    self.telling.setdefault(w, []).append((n, k))

    def scan(self, words: list[str]) -> list[Match]:
        starts: dict[int, list[int]] = {}
        telling = self.telling
        for i, w in enumerate(words):
            if w in telling:
                for n, k in telling[w]:
                    starts.setdefault(n, []).append(i - k)
        found = []
        for n, begins in starts.items():
            name, template = self.templates[n]
            slack, done, tried = max(2, len(template) // 4), 0, None
            for s in sorted(begins):
                if tried is not None and s <= tried:
                    continue
                a, b = max(done, s - slack), min(len(words), s + len(template) + slack)
                pairs = patience(words[a:b], template)
                dense = densest(pairs)
                if len(dense) >= self.coverage * len(template):
                    pairs = dense
                if len(pairs) >= self.coverage * len(template):
                    first, last = a + pairs[0][0], a + pairs[-1][0] + 1
                    if len(pairs) >= self.density * (last - first):
                        found.append(Match(name, len(pairs) / len(template), len(pairs), first, last))
                        done, tried = last, last - 1 - len(template) // 2
                        continue
                tried = s
        kept: list[Match] = []
        for m in sorted(found, key=lambda m: (-m.matched, -m.coverage, m.first, m.license)):
            if not any(m.first < o.last and o.first < m.last for o in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: (m.first, m.license))


_FIELDS = [("license", "string"), ("coverage", "double"), ("matched_words", "int"), ("span_start", "long"), ("span_end", "long")]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """``(doc_id, license, coverage, matched_words, span_start, span_end)`` of every notice found; spans in code points."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in _FIELDS])

    def run(batches):
        scanner = Scanner(templates, coverage, density)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows = []
                for r, raw in enumerate(texts):
                    text = raw.decode()
                    found = scanner.scan(words_of(text))
                    if found:
                        spans = [m.span() for m in _WORD.finditer(text)]
                        rows += [(r, m.license, m.coverage, m.matched, spans[m.first][0], spans[m.last - 1][1]) for m in found]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()),
                         pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], names=schema.names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_patience_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return scan(read(spark, sf, "documents"))


QUERIES = {"op5_patience_licenses": op5_patience_licenses}
ORACLES: dict[str, str] = {}
