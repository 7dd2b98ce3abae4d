"""License scans by conditional compression.

Cues are words of the templates, so many of each that no text can confirm it without one. Around each cue, on both sides and across line breaks, as many words as the longest template may take are
gathered into a candidate block; blocks that meet are joined, and long ones cut into overlapping pieces. A piece is
compressed with each template that it can hold as zstandard raw dictionary, and the templates are ranked by how much
smaller it gets. They are confirmed in that order by exact wording differences: the words of the template are aligned
with those of the piece, and a finding stands only if few words differ and none of the words that tell licenses apart
(numbers, version letters). Words that a template has won are closed to templates that save clearly less; among those
that save about the same, the longest wording, then the one of fewest differences stays. A template that saves little is
still confirmed wherever no clearly better one has won the words.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: License names and wordings that are recognised.
BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "under the MIT License"),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("BSD-2-Clause", BSD_2),
    (
        "BSD-3-Clause",
        BSD_2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'The software is provided "as is" and the author disclaims all warranties',
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: Words that are rare outside of licenses, taken as cues where a template has them.
_RARE = re.compile(r"^(?:licen[cs]|redistribut|unencumbered|gnu$|mozilla$|warrant)")
#: The mark of a list item is no word: a number and a stop after a line's start or a clause's end.
_MARK = re.compile(r"(?:^|(?<=[:;.,]\s))[^\w\n]*\(?(\d{1,2})[.)](?=\s)", re.MULTILINE)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*")
#: The share of a template's words that may differ.
DIFFERENCES = 0.1
#: Savings of two templates above this ratio, or within so many bytes of it (the frame and tables of a compressed text), are too alike to choose between them.
LEAD, NOISE = 0.75, 32
#: Words that tell licenses apart: none of these may be missing or replaced.
_TELLING = re.compile(r"\d|^(?:apache|mit|gnu|lesser|affero|mozilla|bsd|cc|by(?:-\w+)*|sharealike|noncommercial|attribution(?:-\w+)?)$")


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    saved: int
    n_differences: int
    share: float


class Template:
    def __init__(self, name: str, wording: str, level: int = 3):
        self.name, self.wording, self.level = name, wording, level
        self.words = [w.lower() for w in WORD.findall(wording)]

    @cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(self.wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=self.level, dict_data=raw, write_content_size=False, write_checksum=False)

    @cached_property
    def plain(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False)

    @cached_property
    def vocabulary(self) -> frozenset[str]:
        return frozenset(self.words)

    def saving(self, text: str) -> int:
        raw = text.lower().encode()
        return len(self.plain.compress(raw)) - len(self.compressor.compress(raw))

    @cached_property
    def own_saving(self) -> int:
        return self.saving(self.wording)


@lru_cache(maxsize=16)
def cue_of(wordings: tuple[str, ...]) -> re.Pattern:
    """Words of which any text that confirms a template holds one: of each template one more than may differ in it."""
    cues = set()
    for wording in wordings:
        words = [w.lower() for w in WORD.findall(wording)]
        cues.update(sorted(set(words), key=lambda w: (not _RARE.match(w), -len(w), w))[: 1 + int(DIFFERENCES * len(words))])
    return re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, sorted(cues, key=lambda w: (-len(w), w)))) + r")(?![A-Za-z0-9])", re.IGNORECASE)


def _stretch(n: int) -> int:
    """Words among which a template of n words is looked for."""
    return n + 1 + int(DIFFERENCES * n)


def candidate_blocks(text: str, reach: int, cue: re.Pattern) -> list[list[re.Match]]:
    """The words of each block: `reach` words on both sides of each cue, wherever the lines break; marks of list items are none."""
    cues = list(cue.finditer(text))
    if not cues:
        return []
    marks = {m.start(1) for m in _MARK.finditer(text)}
    words = [w for w in WORD.finditer(text) if w.start() not in marks]
    starts = [w.start() for w in words]
    blocks: list[list[int]] = []
    for c in cues:
        first, last = bisect_right(starts, c.start()) - 1, bisect_left(starts, c.end())
        if blocks and first - reach <= blocks[-1][1]:
            blocks[-1][1] = last + reach
        else:
            blocks.append([max(0, first - reach), last + reach])
    return [words[a:b] for a, b in blocks]


def _openings(template: Template, lower: list[str]) -> list[int]:
    """Where the template can start: at one of its first words, with enough of its words in the stretch that follows."""
    n = len(template.words)
    opening, reach = set(template.words[: 1 + int(DIFFERENCES * n)]), _stretch(n)
    held = list(accumulate((w in template.vocabulary for w in lower), initial=0))
    return [j for j, w in enumerate(lower) if w in opening and held[min(j + reach, len(lower))] - held[j] >= (1 - DIFFERENCES) * n]


def confirm(template: Template, text: str, words: list[re.Match], lower: list[str], openings: list[int]) -> list[Finding]:
    """Every place of the block whose words are the template's, but for few differences and no telling one."""
    n, out, begin = len(template.words), [], 0
    while begin < len(lower):
        pairs = _aligned(template.words, lower, openings[bisect_left(openings, begin) :])
        if pairs is None:
            break
        first, last = pairs[0][1], pairs[-1][1] + 1
        matched = {i for i, _ in pairs}
        missing = [w for i, w in enumerate(template.words) if i not in matched]
        extra = [lower[j] for j in range(first, last) if j not in {j for _, j in pairs}]
        differences = max(len(missing), len(extra))
        telling = any(_TELLING.search(w) for w in (*missing, *extra))
        if differences <= DIFFERENCES * n and not telling:
            start, end = words[first].start(), words[last - 1].end()
            saved = template.saving(text[start:end])
            out.append(Finding(template.name, start, end, saved, differences, saved / max(template.own_saving, 1)))
            begin = last
        else:
            begin = first + 1
    return out


def _aligned(want: list[str], have: list[str], openings: list[int]) -> list[tuple[int, int]] | None:
    """Word pairs of the best alignment that starts at the next of the places where the template can start."""
    for j in openings:
        part = have[j : j + _stretch(len(want))]
        if part[: len(want)] == want:
            return [(k, j + k) for k in range(len(want))]
        blocks = difflib.SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks()
        pairs = [(b.a + k, j + b.b + k) for b in blocks for k in range(b.size)]
        if len(pairs) >= (1 - DIFFERENCES) * len(want) and pairs[0][1] == j:
            return pairs
    return None


def pieces(block: list[re.Match], reach: int) -> Iterator[list[re.Match]]:
    """A block in pieces that a dictionary's window covers; any `reach` words in a row lie whole in one of them."""
    for k in range(0, max(len(block) - reach, 1), 3 * reach):
        yield block[k : k + 4 * reach]


def winners(text: str, words: list[re.Match], templates: list[Template]) -> list[Finding]:
    """The piece compressed with each template that it can hold; ranked by bytes saved, and confirmed in that order.

    Words that a template has won are closed to templates that save clearly less (`LEAD`, `NOISE`). Those that save about the same
    differ by so little that all of them are confirmed, and the exact differences decide.
    """
    lower = [w[0].lower() for w in words]
    held = frozenset(lower)
    able = [t for t in templates if len(t.vocabulary - held) <= DIFFERENCES * len(t.words)]
    if not able:
        return []
    part = text[words[0].start() : words[-1].end()]
    ranked = sorted(((t.saving(part), t) for t in able), key=lambda x: (-x[0], x[1].name))
    found: list[tuple[int, Finding]] = []
    for saving, t in ranked:
        closed = sorted((f.start, f.end) for s, f in found if saving + NOISE < LEAD * s)
        for run in _open_runs(words, closed):
            low = lower[run]
            if openings := _openings(t, low):
                found += [(saving, f) for f in confirm(t, text, words[run], low, openings)]
    return [f for _, f in found]


def _open_runs(words: list[re.Match], closed: list[tuple[int, int]]) -> Iterator[slice]:
    """The runs of words outside the closed spans, which are in order."""
    begin, starts = 0, [w.start() for w in words]
    for start, end in closed:
        if (stop := bisect_left(starts, start)) > begin:
            yield slice(begin, stop)
        begin = max(begin, bisect_left(starts, end))
    if begin < len(words):
        yield slice(begin, len(words))


def find_licenses(text: str | None, templates: list[Template]) -> list[Finding]:
    """The licenses of a text by conditional compression: candidate blocks, ranked templates, confirmed winners."""
    found: set[Finding] = set()
    if not text or not templates:
        return []
    cue, reach = cue_of(tuple(t.wording for t in templates)), max(_stretch(len(t.words)) for t in templates)
    for block in candidate_blocks(text, reach, cue):
        for words in pieces(block, reach):
            found.update(winners(text, words, templates))
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f.start - f.end, f.n_differences, -f.share, f.start, f.license)):
        if not any(f.start < o.end and o.start < f.end for o in out):
            out.append(f)
    return sorted(out, key=lambda f: f.start)


OUT_SCHEMA = "doc_id {kind}, license string, start long, end long, saved_bytes long, n_differences long, wording string"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each license wording found: doc_id, license, start, end (code points, exclusive), saved_bytes,
    n_differences, wording. Null and empty texts have none; repeated rows give repeated findings."""
    common.require(docs, key, text)
    common.small_batches(docs.sparkSession)
    names = [c.split(" ")[0] for c in OUT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Template(*t) for t in templates]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows, at = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for f in find_licenses(t, made):
                    at.append(i)
                    rows.append((f.license, f.start, f.end, f.saved, f.n_differences, t[f.start : f.end]))
            if rows:
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, OUT_SCHEMA.format(kind=docs.schema[key].dataType.simpleString()).replace(" end ", " `end` "))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license wordings in all documents."""
    return scan(common.read_table(spark, sf_dir, "documents"))
