"""License scans: Dice coefficient over word bigrams between parts of a text and licence templates."""
from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

THRESHOLD = 0.9

# Public licence texts and notices, by SPDX name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not,
        see <https://www.gnu.org/licenses/>.""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions
        in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": [
        "Licensed under the ISC License.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved."],
}

_BSD_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
    TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
    CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
    OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""
_ISC_DISCLAIMER = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
    CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_3, _GPL_3 = TEMPLATES["BSD-3-Clause"][1], TEMPLATES["GPL-3.0"][2]
_BSD_2 = _BSD_3[:_BSD_3.index("3. Neither")]
TEMPLATES["BSD-3-Clause"].append(_BSD_3 + _BSD_DISCLAIMER)
TEMPLATES["BSD-2-Clause"] += [_BSD_2, _BSD_2 + _BSD_DISCLAIMER]
TEMPLATES["ISC"].append(TEMPLATES["ISC"][1] + _ISC_DISCLAIMER)
# The GNU notices differ in a few words only; without their own texts they would count as the third version's.
TEMPLATES["GPL-2.0"].append(_GPL_3.replace("version 3", "version 2"))
TEMPLATES["LGPL-3.0"].append(_GPL_3.replace("General Public", "Lesser General Public"))
TEMPLATES["AGPL-3.0"].append(_GPL_3.replace("General Public", "Affero General Public"))

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"""\n|[.!?]["')\]]*(?=\s)""")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def normalised(text: str) -> list[str]:
    """Lower-case words of letters and digits; punctuation and white space are gone."""
    return _WORD.findall(text.lower())


class Templates:
    """Bigram sets of the templates in order of size, and all their bigrams with the least size."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        rows = []
        for name, texts in templates.items():
            for t in texts:
                words = normalised(t)
                rows.append((frozenset(zip(words, words[1:])), name, len(words)))
        rows = sorted((r for r in rows if r[0]), key=lambda r: (len(r[0]), r[1]))
        self.rows, self.words = [r[:2] for r in rows], [r[2] for r in rows]
        self.every = frozenset().union(*(r[0] for r in self.rows))
        self.least = min((len(r[0]) for r in self.rows), default=0)
        # Dice 2s / (a + b) >= t with s <= min(a, b) bounds a between b * t / (2 - t) and b * (2 - t) / t.
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold

    def best(self, grams: set) -> tuple[str, float] | None:
        """The template of highest Dice at or over the threshold; ties go to the smaller template, then the name."""
        known = len(grams & self.every)
        if not known or 2 * known < self.threshold * (len(grams) + self.least):
            return None
        found = None
        for b, name in self.rows:
            if len(b) < self.low * len(grams) - 1e-9:
                continue
            if len(b) > self.high * len(grams) + 1e-9:
                break
            dice = 2 * len(grams & b) / (len(grams) + len(b))
            if dice >= self.threshold and (found is None or dice > found[1]):
                found = (name, dice)
        return found


@lru_cache(maxsize=4)
def _compiled(threshold: float) -> Templates:
    return Templates(TEMPLATES, threshold)


def _runs(words: list[str], cuts: list[int], at: int, templates: Templates) -> list[tuple]:
    """Runs of neighbouring pieces whose Dice with one template reaches the threshold: (shared, dice, template, start, end).

    ``cuts`` are the first words of the pieces and the end of the text. A run of Dice t holds at
    most b (2 - 2t) / t bigrams that are not of the template, so most runs end after a few words.
    """
    grams, name = templates.rows[at]
    b, t = len(grams), templates.threshold
    most, longest = b * (2 - 2 * t) / t + 1e-9, templates.high * templates.words[at] + 1
    known = [g in grams for g in zip(words, words[1:])]
    found = []
    for i, start in enumerate(cuts[:-1]):
        if not any(known[start:cuts[i + 1]]):
            continue
        seen, shared, k = set(), 0, start
        for end in cuts[i + 1:]:
            if end - start > longest:
                break
            while k < end - 1 and len(seen) - shared <= most:
                g = (words[k], words[k + 1])
                if g not in seen:
                    seen.add(g)
                    shared += known[k]
                k += 1
            if len(seen) - shared > most:
                break
            dice = 2 * shared / (len(seen) + b)
            if dice >= t:
                found.append((shared, dice, at, start, end))
    return found


def _chosen(runs: list[tuple], parts: list[list[int]], templates: Templates) -> list[tuple[str, float]]:
    """Disjoint runs: of one template the highest Dice, of several templates the most shared bigrams.

    A line or paragraph around a chosen run that reaches the threshold by itself is one match.
    ``parts`` are the borders of paragraphs and of lines. Every template has a queue of its
    runs; covered words are kept as sorted disjoint intervals, against which a run is
    tested when it comes up, so n runs take n log n steps.
    """
    queues, whole = {}, {(r[2], r[3], r[4]) for r in runs}
    for order, r in enumerate(sorted(runs, key=lambda r: r[3])):
        queues.setdefault(r[2], []).append((-r[1], r[3] - r[4], order, r))
    for q in queues.values():
        heapq.heapify(q)
    out, lows, highs = [], [], []

    def free(start: int, end: int) -> bool:
        i = bisect_right(highs, start)
        return i == len(lows) or lows[i] >= end

    while True:
        for at in list(queues):
            while queues[at] and not free(*queues[at][0][3][3:]):
                heapq.heappop(queues[at])
            if not queues[at]:
                del queues[at]
        if not queues:
            return [m[1:] for m in sorted(out)]
        _, dice, at, start, end = max((q[0][3] for q in queues.values()), key=lambda r: (r[0], r[1], -r[2], -r[3]))
        out.append((start, templates.rows[at][1], dice))
        low, high = start, end
        for borders in parts:
            i = bisect_right(borders, start)
            a, b = borders[i - 1], borders[i] if i < len(borders) else end
            if end <= b and (at, a, b) in whole and free(a, b):
                low, high = min(low, a), max(high, b)
        i = bisect_right(highs, low)
        lows.insert(i, low)
        highs.insert(i, high)


def scan(text: str | None, templates: Templates) -> list[tuple[str, float]]:
    """Matches of the whole text, else of runs of neighbouring sentences, lines and paragraphs.

    Lines and sentences are the pieces; a run may begin and end at any of them, so a notice
    over several paragraphs or a sentence that wraps is one run.
    """
    low = text.lower() if text else ""
    words = _WORD.findall(low)
    grams = set(zip(words, words[1:]))
    known = grams & templates.every
    if not known:
        return []
    hit = templates.best(grams)
    if hit:
        return [hit]
    # Dice at the threshold needs this share of the template's bigrams in the text.
    near = [i for i, (g, _) in enumerate(templates.rows) if len(g) * templates.low <= len(known) + 1e-9 and len(g & known) >= len(g) * templates.low - 1e-9]
    if not near:
        return []
    starts = [m.start() for m in _WORD.finditer(low)]

    def word_at(breaks) -> list[int]:
        return sorted({0, len(words), *(bisect_left(starts, m.end()) for m in breaks)})

    cuts = word_at(_BREAK.finditer(low))
    parts = [word_at(_PARAGRAPH.finditer(low)), word_at(re.finditer("\n", low))]
    return _chosen([r for i in near for r in _runs(words, cuts, i, templates)], parts, templates)


def licence_scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licence, dice, n_matches, licences`` per document.

    ``licence`` is the template of the best match, ties to the earlier one; ``licences`` all
    matched names, sorted and comma-joined. Compared are the whole text and, where that is no
    match, all runs of neighbouring sentences, lines and paragraphs of a template's size. Null, empty and other texts without a match have a
    null licence, dice 0, no matches and an empty list. Every input row gives one row; other
    columns are ignored. Templates are constants of the code; nothing is shuffled.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scanned(batches):
        templates = _compiled(threshold)
        for b in batches:
            best, dice, n, names = [], [], [], []
            for t in b.column("text"):
                found = scan(t.as_py(), templates)
                top = max(found, key=lambda f: f[1], default=(None, 0.0))
                best.append(top[0])
                dice.append(top[1])
                n.append(len(found))
                names.append(",".join(sorted({f[0] for f in found})))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best, pa.string()), pa.array(dice, pa.float64()), pa.array(n, pa.int64()), pa.array(names, pa.string())],
                                             names=["doc_id", "licence", "dice", "n_matches", "licences"])

    return raw.mapInArrow(scanned, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, licence string, dice double, n_matches long, licences string")
