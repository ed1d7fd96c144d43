"""License scans by patience alignment.

Words of text and template (lower case) are aligned: equal ends are matched, words
that are unique to both sides are anchors, their longest increasing subsequence is
kept, and the gaps between are aligned the same way. A template's coverage is the
share of its words that are aligned.

A template is reported for a text if at least `coverage` of its words stand in the text
in the template's order, however far apart. Its marks (words between asterisks: a name,
a version) have to be among them, each as a run of neighbours; a first mark goes with
the next occurrence of each later one, if no other first mark stands between. Templates of fewer than `SHORT` words are reported
only where they stand word for word.

No place is lost: the most words that any alignment could hold is the length of the
longest common subsequence, counted bit-parallel over the whole text. Where it reaches
the coverage, a template without marks gets the shortest span that ends first, one with
marks is aligned around each of its marks, with near words if they reach the coverage
and else with all. The span is aligned by patience; where a longest common subsequence
holds more words, it stands instead. The aligned words are taken out and the rest is
searched again, so each place of a license that a text repeats is reported. Words that
several reports claim go to the best (coverage, words aligned, tightness, name); a
report stays if what is left to it still reaches the coverage.

Defined results: null and empty texts have no report; a text that repeats a license
gets a report for each place; rows that repeat a document are scanned each; a null
id is passed on; templates without words are left out; other columns aren't read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharpsieve.llm.common import decoded

COVERAGE, SHORT = 0.8, 16
#: Words that are seeds only if nothing else is left.
COMMON = frozenset("a all an and any are as at be by can file for free from have if in is it its may no not of on one or other out see that the this to under use with without work you your".split())
_word = re.compile(r"[a-z]+|\d+(?:\.\d+)*")

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the *{name}* as published by the Free Software Foundation, "
    "either *version {n} of the License*, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the "
    "{name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)

#: Texts of licenses and the notices that stand for them; marks between asterisks.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "BSD-notice": "Released under the BSD License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + (
        " 3. Neither the name of the *copyright holder nor the names of its contributors* may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "Apache-2.0": (
        "Licensed under the *Apache License, Version 2.0* (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": _GNU.format(name="GNU General Public License", n=2),
    "GPL-3.0": _GNU.format(name="GNU General Public License", n=3),
    "LGPL-2.1": _GNU.format(name="GNU Lesser General Public License", n=2.1),
    "LGPL-3.0": _GNU.format(name="GNU Lesser General Public License", n=3),
    "AGPL-3.0": _GNU.format(name="GNU Affero General Public License", n=3),
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the *Mozilla Public License, v. 2.0*. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is *free and unencumbered software released into the public domain*. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under *CC0 1.0*.",
}


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


def longest_rising(values: list[int]) -> list[int]:
    """The places of a longest strictly rising subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(template: list, text: list) -> list[tuple[int, int]]:
    """Pairs of places (template, text) of equal words, rising on both sides."""
    out, todo = [], [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(template[a:b]), Counter(text[c:d])
        spots = {text[j]: j for j in range(c, d) if right[text[j]] == 1 and left.get(text[j]) == 1}
        anchors = [(i, spots[template[i]]) for i in range(a, b) if template[i] in spots]
        anchors = [anchors[k] for k in longest_rising([j for _, j in anchors])]
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if anchors and k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def runs(text: list[str], phrase: list[str]) -> list[int]:
    """Where the words of phrase stand as neighbours."""
    n, out, at = len(phrase), [], -1
    while True:
        try:
            at = text.index(phrase[0], at + 1)
        except ValueError:
            return out
        if text[at : at + n] == phrase:
            out.append(at)


def _masks(template: list[str]) -> dict[str, int]:
    """For each word a bit mask of its places."""
    out: dict[str, int] = {}
    for i, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places (template, text), as late in the text as can be."""
    masks, full = _masks(template), (1 << len(template)) - 1
    states, state = [full], full
    for w in text:
        hit = state & masks.get(w, 0)
        state = (state + hit | state - hit) & full
        states.append(state)
    out, i = [], len(template)
    size = lambda s, n: n - (s & (1 << n) - 1).bit_count()
    for j in range(len(text), 0, -1):
        while i and size(states[j], i) == size(states[j], i - 1):
            i -= 1
        if i and size(states[j - 1], i) < size(states[j], i):
            i -= 1
            out.append((i, j - 1))
    return out[::-1]


def early(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """common, but as early in the text as can be."""
    n, m = len(template) - 1, len(text) - 1
    return [(n - i, m - j) for i, j in common(template[::-1], text[::-1])][::-1]


class Pattern:
    """A template's words and marks, and the masks of its words for both directions."""

    def __init__(self, text: str):
        self.words: list[str] = []
        self.marks: list[tuple[int, int]] = []
        for k, part in enumerate(text.split("*")):
            own = words(part)
            if k % 2 and own:
                self.marks.append((len(self.words), len(self.words) + len(own)))
            self.words += own
        self.counts = Counter(self.words)
        self.full = (1 << len(self.words)) - 1
        self.ahead, self.behind = _masks(self.words), _masks(self.words[::-1])

    def reach(self, text: list[str], need: int, *, back: bool = False) -> int | None:
        """After how many words of text (from its end if back; all of them the template's) a common subsequence has `need` words, or None."""
        masks, state = self.behind if back else self.ahead, self.full
        for k, w in enumerate(reversed(text) if back else text, 1):
            hit = state & masks[w]
            state = (state + hit | state - hit) & self.full
            if k >= need and len(self.words) - state.bit_count() >= need:
                return k
        return None

    def length(self, text: list[str]) -> int:
        """The length of a longest common subsequence."""
        state = self.full
        for w in text:
            hit = state & self.ahead[w]
            state = (state + hit | state - hit) & self.full
        return len(self.words) - state.bit_count()

    def marked(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether the pairs hold each mark as a run of neighbours in the text."""
        at = dict(pairs)
        return all(all(a in at and at.get(i) == at[a] + i - a for i in range(a, b)) for a, b in self.marks)


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, short: int = SHORT):
        self.coverage, self.short = coverage, short
        self.templates = {k: p for k, t in templates.items() if (p := Pattern(t)).words}
        common = Counter(x for p in self.templates.values() for x in set(p.words))
        self.seeds: dict[str, set[str]] = {}
        for name, p in self.templates.items():
            held, left = Counter(p.words), len(p.words)
            chosen: set[str] = set()
            for x in sorted(held, key=lambda x: (x in COMMON, common[x], -len(x), x)):
                if left < self.need(p):
                    break
                chosen.add(x)
                left -= held[x]
            self.seeds[name] = chosen
        self.all_seeds = sorted(set().union(*self.seeds.values()), key=lambda x: (-len(x), x)) if self.seeds else []

    def need(self, p: Pattern) -> int:
        return len(p.words) if len(p.words) < self.short else math.ceil(self.coverage * len(p.words) - 1e-9)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, words aligned, first and end character) of each report."""
        low = text.lower()
        if not any(x in low for x in self.all_seeds):
            return []
        spans = [m.span() for m in _word.finditer(low)]
        found = [low[a:b] for a, b in spans]
        return [(name, len(own) / len(self.templates[name].words), len(own), spans[own[0][1]][0], spans[own[-1][1]][1]) for name, own in self.reports(found)]

    def reports(self, text: list[str]) -> list[tuple[str, list[tuple[int, int]]]]:
        """(license, aligned pairs) of each report, by place in the text."""
        have = Counter(text)
        found = []
        for name, p in self.templates.items():
            if self.seeds[name].isdisjoint(have) or sum(min(n, have[x]) for x, n in p.counts.items()) < self.need(p):
                continue
            if len(p.words) < self.short:
                found += [(name, [(i, at + i) for i in range(len(p.words))]) for at in runs(text, p.words)]
                continue
            rest = [i for i, x in enumerate(text) if x in p.counts]
            if p.reach([text[i] for i in rest], self.need(p)) is not None:
                found += [(name, own) for own in (self.around_marks if p.marks else self.spans)(p, text, rest)]
        return self.settled(found)

    def spans(self, p: Pattern, text: list[str], rest: list[int]) -> Iterator[list[tuple[int, int]]]:
        """Alignments of a template without marks, each with words of its own."""
        need, more = self.need(p), 2 * (len(p.words) - self.need(p))
        while True:
            own = [text[i] for i in rest]
            end = p.reach(own, need)
            if end is None:
                return
            start = end - p.reach(own[:end], need, back=True)
            near = own[max(0, start - more) : end + more]  # the words that are still missing are near, or stay away
            n = p.length(near)
            high = max(0, start - more) + p.reach(near, n)
            low = high - p.reach(own[max(0, start - more) : high], n, back=True)
            pairs = max(align(p.words, own[low:high]), common(p.words, own[low:high]), key=len)
            yield [(i, rest[low + j]) for i, j in pairs]
            taken = {low + j for _, j in pairs}
            rest = [x for k, x in enumerate(rest) if k not in taken]

    def around_marks(self, p: Pattern, text: list[str], rest: list[int]) -> Iterator[list[tuple[int, int]]]:
        """Alignments around the marks of a template, each with words of its own."""
        need, spots, taken = self.need(p), [runs(text, p.words[a:b]) for a, b in p.marks], set()
        for n, first in enumerate(spots[0], 1):
            chain = [first]
            for (a, b), own in zip(p.marks, spots[1:], strict=False):
                k = bisect.bisect_left(own, chain[-1] + b - a)
                if k == len(own):
                    return
                chain.append(own[k])
            if len(chain) > 1 and n < len(spots[0]) and spots[0][n] + p.marks[0][1] - p.marks[0][0] <= chain[1]:
                continue  # another first mark is nearer
            marked = [(a + k, q + k) for (a, b), q in zip(p.marks, chain, strict=True) for k in range(b - a)]
            if any(j in taken for _, j in marked):
                continue
            ends = [q + b - a for (a, b), q in zip(p.marks, chain, strict=True)]
            parts = list(zip([0, *(b for _, b in p.marks)], [*(a for a, _ in p.marks), len(p.words)], strict=True))
            for far in (2 * len(p.words), len(text)):  # near words, or all
                places = list(zip([max(0, first - far), *ends], [*chain, ends[-1] + far], strict=True))
                pairs = list(marked)
                for k, ((a, b), (c, d)) in enumerate(zip(parts, places, strict=True)):
                    own = rest[bisect.bisect_left(rest, c) : bisect.bisect_left(rest, d)]
                    said = [text[i] for i in own]
                    best = max(align(p.words[a:b], said), (early if k == len(parts) - 1 else common)(p.words[a:b], said), key=len)
                    pairs += [(a + i, own[j]) for i, j in best]
                if len(pairs) >= need:
                    yield sorted(pairs)
                    taken |= {j for _, j in pairs}
                    rest = [i for i in rest if i not in taken]
                    break

    def settled(self, found: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[str, list[tuple[int, int]]]]:
        """Words that several reports claim go to the best of them."""
        taken: set[int] = set()
        out = []
        for name, own in sorted(found, key=lambda r: (-len(r[1]) / len(self.templates[r[0]].words), -len(r[1]), r[1][-1][1] - r[1][0][1], r[0], r[1])):
            left = [(i, j) for i, j in own if j not in taken]
            p = self.templates[name]
            if len(left) >= self.need(p) and p.marked(left):
                taken |= {j for _, j in left}
                out.append((name, left))
        return sorted(out, key=lambda r: r[1][0][1])


def scan(docs: DataFrame, *, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, coverage, n_words, start_char, end_char: a row for each license found in a document (places in the lower-cased text)."""
    chosen = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage, short)
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for batch, found in decoded(batches):
            rows = [(i, r) for i, x in enumerate(found) for r in scanner.scan(x)]
            cols = [batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))]
            cols += [pa.array([r[k] for _, r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "license", "coverage", "n_words", "start_char", "end_char"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"id {kind}, license string, coverage double, n_words long, start_char long, end_char long")
