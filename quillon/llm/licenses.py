"""License scans by conditional compression.

A block is a run of lines around words that notices use. It is compressed on its
own and with each license template as a raw zstandard dictionary; the bytes that a
template saves, as a share of the template's own compressed size, rank the
templates whatever else the block holds. Those that save enough are confirmed by
their exact differences in wording, from an alignment of the template's words
inside the block's: words around the match are free, but a difference in a name, a
version number or a negation rejects it, and so does a negation just before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_BSD_TOP = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."


def _phrases(*names: str) -> tuple[str, ...]:
    """The usual sentences that name a license."""
    return tuple(f"{verb} under the {name}" for name in names for verb in ("licensed", "released", "distributed", "available"))


def _creative(kind: str, short: str) -> dict[str, tuple[str, ...]]:
    versions = ("2.0", "2.5", "3.0", "4.0")
    return {f"CC-{short}-{v}": (f"Creative Commons Attribution{kind} {v}", f"under CC {short} {v}") for v in versions}


#: By license, the public wording of its text, its notice, and sentences that name it.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        *_phrases("Apache License, Version 2.0", "Apache 2.0 License"),
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        f"{_WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        *_phrases("MIT License"),
    ),
    "BSD-2-Clause": (f"{_BSD_TOP} {_BSD_END}", *_phrases("BSD 2-Clause License")),
    "BSD-3-Clause": (f"{_BSD_TOP} {_BSD_THIRD} {_BSD_END}", *_phrases("BSD 3-Clause License")),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        *_phrases("ISC License"),
    ),
    "GPL-2.0": (_GNU.format("", 2), *_phrases("GNU General Public License, version 2", "GPL v2")),
    "GPL-3.0": (_GNU.format("", 3), *_phrases("GNU General Public License, version 3", "GPL v3")),
    "LGPL-2.1": (_GNU.format("Lesser ", "2.1"), *_phrases("GNU Lesser General Public License, version 2.1")),
    "LGPL-3.0": (_GNU.format("Lesser ", 3), *_phrases("GNU Lesser General Public License, version 3")),
    "AGPL-3.0": (_GNU.format("Affero ", 3), *_phrases("GNU Affero General Public License, version 3")),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        *_phrases("Mozilla Public License, version 2.0"),
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal"),
    **_creative("", "BY"), **_creative("-ShareAlike", "BY-SA"), **_creative("-NoDerivatives", "BY-ND"), **_creative("-NonCommercial", "BY-NC"),
    **_creative("-NonCommercial-ShareAlike", "BY-NC-SA"), **_creative("-NonCommercial-NoDerivatives", "BY-NC-ND"),
}
#: What lines of a notice are known by; words of which none may differ; words that turn what follows them round.
CUES = r"(?i)licen[cs]e|copyright|\bpermission|permitted|redistribut|warrant|\bliab|free software|public domain|creative commons|\bcc0?\b|disclaim|damages|as[ -]is\b|\b[al]?gpl\b|\bgnu\b|(?:released|distributed|available) under"
DECISIVE = frozenset("mit apache bsd gnu gpl lesser library affero mozilla mpl isc zlib boost eclipse cc cc0 by nc sa nd attribution noncommercial sharealike noderivatives noderivs commercial clause".split())
NEGATIONS = frozenset("not never no nor neither without cannot unlike except isn't aren't wasn't don't doesn't".split())
#: Lines without a cue that may stand between two with one, words that a block takes in on either side, bytes compressed at once and shared by neighbours.
GAP, AROUND, PIECE, OVERLAP = 6, 40, 128 << 10, 8 << 10
_BLOCK = pa.struct([("ordinal", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("confirmed", pa.bool_())])
_SCHEMA = "doc_id long, n_blocks long, licenses array<string>, blocks array<struct<ordinal:int, first_line:int, last_line:int, license:string, reduction:double, missing:array<string>, added:array<string>, confirmed:boolean>>"


def words(text: str) -> list[str]:
    """Lower-case words with letters, digits and inner points or apostrophes; numbers that only count list items are none."""
    flat = re.sub(r"(?m)^[\s#*/;>-]*\(?\d{1,2}[.)]\s", " ", text.lower().replace("’", "'"))
    return re.findall(r"\w+(?:[.']\w+)*", flat)


def aligned(template: np.ndarray, block: np.ndarray, most: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(start, end, template's words missing, block's words added) of the places in ``block`` with at most ``most`` differences, best first.

    Both are word numbers. One pass of edit distance with free ends on the
    block's side, row by row of the template; places do not overlap.
    """
    n = len(block)
    cost = np.zeros((len(template) + 1, n + 1), np.int32)
    steps = np.arange(n + 1)
    for i, word in enumerate(template, 1):
        row = np.empty(n + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, :-1] + (block != word), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(row - steps) + steps
    taken = np.zeros(n + 1, bool)
    ends = np.flatnonzero(cost[-1] <= most)
    for end in ends[np.argsort(cost[-1, ends], kind="stable")].tolist():
        i, j, missing, added = len(template), end, [], []
        while i:
            here = cost[i, j]
            if j and cost[i - 1, j - 1] + (block[j - 1] != template[i - 1]) == here:
                if block[j - 1] != template[i - 1]:
                    missing.append(i - 1)
                    added.append(j - 1)
                i, j = i - 1, j - 1
            elif cost[i - 1, j] + 1 == here:
                missing.append(i - 1)
                i -= 1
            else:
                added.append(j - 1)
                j -= 1
        if end > j and not taken[j:end].any():
            taken[j:end] = True
            yield j, end, missing[::-1], added[::-1]


class Scanner:
    """Ranks templates for blocks; keeps answers for blocks that come again, up to a number."""

    def __init__(self, templates: Mapping[str, Sequence[str]], least_reduction: float, most_changed: float) -> None:
        import zstandard

        plain = {"level": 3, "write_checksum": False, "write_content_size": False}
        self.plain = zstandard.ZstdCompressor(**plain)
        self.templates = []
        for name, texts in templates.items():
            for text in texts:
                own = words(text)
                flat = " ".join(own).encode()
                primed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(flat, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_dict_id=False, **plain)
                self.templates.append((name, own, len(self.plain.compress(flat)), primed))
        self.least_reduction, self.most_changed = least_reduction, most_changed
        self.kept: dict[str, list[tuple]] = {}

    def judge(self, block: str) -> list[tuple]:
        """(license, reduction, missing, added, confirmed) of each license that the block holds, else of the best template unconfirmed."""
        found = self.kept.get(block)
        if found is None:
            found = self._judged(words(block))
            if len(self.kept) >= 4096:
                self.kept.clear()
            self.kept[block] = found
        return found

    def _judged(self, own: list[str]) -> list[tuple]:
        data = " ".join(own).encode()
        parts = [data[i : i + PIECE + OVERLAP] for i in range(0, max(1, len(data)), PIECE)]
        alone = [len(self.plain.compress(x)) for x in parts]
        ranked = []
        for at, (name, text, size, primed) in enumerate(self.templates):
            saved = max(a - len(primed.compress(x)) for a, x in zip(alone, parts, strict=True))
            ranked.append((-saved / size, name, at))
        ranked.sort()
        numbers: dict[str, int] = {}
        block = np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int32)
        held, first = [], None
        for reduction, name, at in ranked:
            if -reduction < self.least_reduction:
                break
            text = self.templates[at][1]
            coded = np.array([numbers.get(w, -1) for w in text], np.int32)
            for start, end, missing, added in aligned(coded, block, int(self.most_changed * len(text))):
                row = (name, -reduction, [text[i] for i in missing], [own[j] for j in added])
                if self._decides(text, missing, own, added, start):
                    first = first or (*row, False)
                else:
                    held.append((start, end, (*row, True)))
        # A license inside a longer match of another one is part of that one's wording.
        rows = [x for x in held if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in held)]
        best: dict[str, tuple] = {}
        for start, end, row in sorted(rows, key=lambda x: (x[0] - x[1], x[0], x[2][0])):
            best.setdefault(row[0], row)
        if best:
            return list(best.values())
        return [first or (ranked[0][1], -ranked[0][0], [], [], False)]

    @staticmethod
    def _decides(text: list[str], missing: list[int], own: list[str], added: list[int], start: int) -> bool:
        """Whether the differences, or a negation before the match, make it another license or none."""

        def counts(all_: list[str], at: int) -> bool:
            word = all_[at]
            version = re.fullmatch(r"v?\d+(?:\.\d+)*", word) and ("." in word or word[0] == "v" or (at and all_[at - 1] in ("version", "v", "license", "gpl", "bsd")))
            return bool(version) or word in DECISIVE or word in NEGATIONS

        return any(counts(text, i) for i in missing) or any(counts(own, j) for j in added) or any(w in NEGATIONS for w in own[max(0, start - 3) : start])


def blocks(text: str, cues: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of the lines around cues.

    Lines with a cue no more than GAP lines apart belong together; a block takes
    in lines on either side, up to a blank one or AROUND words.
    """
    lines = text.split("\n")
    marked = [i for i, line in enumerate(lines) if cues.search(line)]
    at = 0
    while at < len(marked):
        lo = hi = marked[at]
        while at < len(marked) and marked[at] - hi <= GAP + 1:
            hi = marked[at]
            at += 1
        for step in (-1, 1):
            room, edge = AROUND, lo if step < 0 else hi
            while room > 0 and 0 <= edge + step < len(lines) and lines[edge + step].strip():
                edge += step
                room -= len(lines[edge].split())
            lo, hi = (edge, hi) if step < 0 else (lo, edge)
        yield lo, hi, "\n".join(lines[lo : hi + 1])


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, cues: str = CUES, least_reduction: float = 0.2, most_changed: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_blocks, licenses, blocks).

    licenses are the distinct confirmed ones, sorted. blocks has an entry for each
    license confirmed in a block, or one for its best template: the block's lines,
    the license, the share of the template's compressed size that it saves, missing
    and added words, and whether it is confirmed: at least ``least_reduction``
    saved, at most ``most_changed`` of the template's words changed, none of them
    decisive. Defined cases: null, empty or cue-free text has no blocks; a block of
    any length is judged whole; templates that save alike rank by name; repeated
    rows are judged alike; an empty table gives an empty result; other columns are
    ignored.
    """
    texts, pattern = dict(templates), cues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cue, scanner = re.compile(pattern), Scanner(texts, least_reduction, most_changed)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                rows, counts = [], []
                for text in batch.column(1)[lo : lo + 1024].to_pylist():
                    own, n = [], 0
                    for first, last, block in blocks(text, cue) if text and cue.search(text) else ():
                        n += 1
                        for name, reduction, missing, added, sure in scanner.judge(block):
                            own.append({"ordinal": len(own), "first_line": first, "last_line": last, "license": name, "reduction": reduction, "missing": missing, "added": added, "confirmed": sure})
                    rows.append(own)
                    counts.append(n)
                names = [sorted({b["license"] for b in own if b["confirmed"]}) for own in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 1024], pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(rows, pa.list_(_BLOCK))], names=["doc_id", "n_blocks", "licenses", "blocks"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
