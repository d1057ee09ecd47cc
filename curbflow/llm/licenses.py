"""License scans by patience alignment of texts with license templates.

Words that stand once in a stretch of the text and once in the template are anchors;
the longest run of anchors in the same order is kept and the gaps between them are
aligned in the same way. Coverage is the share of the template's words that align.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

# Parts that licenses share.
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met"
)
_BSD_SOURCE = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer."
)
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_OPENING = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction"
)
_APACHE_OPENING = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at"
)

# Statements, opening sentences and whole texts of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without permission.",
    # A text cut off after its first sentence; BSD-2-Clause and BSD-3-Clause begin alike.
    "BSD-opening": _BSD_OPENING,
    "MIT-opening": _MIT_OPENING,
    "Apache-2.0-opening": _APACHE_OPENING,
    "BSD-2-Clause": f"{_BSD_OPENING}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_OPENING}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "MIT-text": (
        f"{_MIT_OPENING}, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
        "do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-text": (
        f"{_APACHE_OPENING} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
}

# Licenses that differ by one clause: the clause, and whether it stands in the license.
TELLING = {"BSD-2-Clause": (_BSD_NAMES, False), "BSD-3-Clause": (_BSD_NAMES, True)}

MIN_COVERAGE = 0.8
# Words from the first to the last of a statement, foreign ones included, per word of its template.
MAX_SPAN = 16
WORD = re.compile(r"\w+(?:[.-]\w+)*")


def lowered(text: str) -> str:
    """Lower case, character for character: one that would become two stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for k, value in enumerate(values):
        at = bisect_left(tops, value)
        before[k] = piles[at - 1] if at else -1
        tops[at : at + 1] = [value]
        piles[at : at + 1] = [k]
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of text and template, increasing in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            pairs.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            pairs.append((a_end, b_end))
        if a >= a_end or b >= b_end:
            continue
        mine, theirs = Counter(text[a:a_end]), Counter(template[b:b_end])
        place = {w: k for k, w in enumerate(template[b:b_end], b) if theirs[w] == 1 and mine[w] == 1}
        shared = [(k, place[w]) for k, w in enumerate(text[a:a_end], a) if w in place]
        anchors = [shared[k] for k in longest_increasing([y for _, y in shared])]
        if not anchors:
            continue
        pairs += anchors
        edges = [(a - 1, b - 1), *anchors, (a_end, b_end)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]) if x + 1 < u and y + 1 < v]
    return sorted(pairs)


class Scanner:
    """Finds the stretches of a text that cover a template."""

    def __init__(
        self, templates: dict[str, str], min_coverage: float, telling: dict[str, tuple[str, bool]] | None = None,
        max_span: int | None = MAX_SPAN,
    ):
        self.max_span = max_span
        self.words = {name: words_of(t) for name, t in templates.items()}
        self.words = {name: w for name, w in self.words.items() if w}
        self.least = {name: max(1, int(np.ceil(min_coverage * len(w)))) for name, w in self.words.items()}
        self.sets = {name: Counter(w) for name, w in self.words.items()}
        self.telling = {name: (words_of(clause), stands) for name, (clause, stands) in (telling or {}).items()}
        self.min_coverage = min_coverage
        # At most so many words may be missing: one of any set with one more must stand in the text.
        self.keys = {
            name: sorted(w, key=lambda x: (-len(x), x))[: len(w) - self.least[name] + 1]
            for name, w in self.words.items()
        }

    def told(self, name: str, words: list[str]) -> bool:
        """Whether a stretch has the clause that tells its license from another, or lacks it, as it should."""
        if name not in self.telling:
            return True
        clause, stands = self.telling[name]
        return (len(align(words, clause)) >= self.min_coverage * len(clause)) == stands

    def scan(self, text: str) -> Iterator[tuple[str, float, int, int, list[tuple[int, int]]]]:
        """Template, coverage, first and last character, and matched runs as (character, length)."""
        low = lowered(text)
        names = [n for n, keys in self.keys.items() if any(k in low for k in keys)]
        if not names:
            return
        hits = list(WORD.finditer(low))
        words = [h.group() for h in hits]
        for name in names:
            template, least = self.words[name], self.least[name]
            own = self.sets[name]
            at = np.array([k for k, w in enumerate(words) if w in own], np.int64)
            if len(at) < least:
                continue
            free = [(0, len(words))]
            for places in self._close(words, at, template, least):
                free = without(free, places[0], places[-1] + 1)
                if self.told(name, words[places[0] : places[-1] + 1]):
                    yield self._hit(name, places, hits, template)
            for places in self._spread(words, at, template, least, own, free):
                if self.told(name, words[places[0] : places[-1] + 1]):
                    yield self._hit(name, places, hits, template)

    @staticmethod
    def _hit(name: str, places: list[int], hits: list[re.Match], template: list[str]):
        cuts = [0, *[i for i in range(1, len(places)) if places[i] != places[i - 1] + 1], len(places)]
        runs = [
            (hits[places[i]].start(), hits[places[j - 1]].end() - hits[places[i]].start())
            for i, j in zip(cuts, cuts[1:])
        ]
        return name, len(places) / len(template), hits[places[0]].start(), hits[places[-1]].end(), runs

    @staticmethod
    def _close(words: list[str], at: np.ndarray, template: list[str], least: int) -> Iterator[list[int]]:
        """Aligned words of statements that lie within twice the template's length, one after another."""
        reach = 2 * len(template)
        near = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < reach)
        end = -1
        for k in near.tolist():
            if at[k] < end:
                continue
            first, last = int(at[k]), int(min(len(words), at[k] + reach))
            pairs = align(words[first:last], template)
            if len(pairs) < least:
                continue
            # Other words in front may have cut the end of the license off.
            while len(pairs) < len(template):
                last = min(len(words), first + pairs[-1][0] + 1 + reach)
                longer = align(words[first:last], template)
                if len(longer) <= len(pairs):
                    break
                pairs = longer
            places = [first + x for x, _ in pairs]
            # An earlier copy may begin before its last words: go on after what aligned.
            end = places[-1] + 1
            yield places

    def _spread(
        self, words: list[str], at: np.ndarray, template: list[str], least: int, own: Counter, free: list[tuple[int, int]]
    ) -> Iterator[list[int]]:
        """Aligned words of statements with more foreign words between their parts.

        Windows double from four times the template's length, each overlapping the next by
        half, so a statement lies whole in a window at most four times as long as it is. Words of
        statements found already are left out. A window without enough of the template's words,
        each counted as often as the template has it, is passed over.
        """
        most = len(words) if self.max_span is None else self.max_span * len(template)
        reach = 4 * len(template)
        while reach < 4 * most:
            found = []
            for low, high in free:
                start = low
                while start < high:
                    stop = min(high, start + reach)
                    inside = Counter(words[p] for p in at[np.searchsorted(at, start) : np.searchsorted(at, stop)].tolist())
                    if sum((inside & own).values()) >= least:
                        pairs = align(words[start:stop], template)
                        if len(pairs) >= least and pairs[-1][0] - pairs[0][0] < most:
                            places = [start + x for x, _ in pairs]
                            found.append(places)
                            yield places
                            start = places[-1] + 1
                            continue
                    if stop == high:
                        break
                    start += max(1, reach // 2)
            for places in found:
                free = without(free, places[0], places[-1] + 1)
            if reach >= 2 * len(words):
                break
            reach *= 2


def without(free: list[tuple[int, int]], start: int, stop: int) -> list[tuple[int, int]]:
    """The ranges of ``free`` without one range."""
    cut = [part for low, high in free for part in ((low, min(high, start)), (max(low, stop), high))]
    return [(low, high) for low, high in cut if low < high]


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE,
    max_span: int | None = MAX_SPAN, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document, template and place where the template is covered.

    Returns ``doc_id``, ``license``, ``coverage``, ``start`` and ``stop`` (characters of
    the text) and ``runs``, the stretches of words that align one after another.
    Case and punctuation are ignored. Other words may stand between the parts of a
    statement; with them it may be ``max_span`` times as long as its template, with None
    as long as the text. A license stated twice gives two rows; a null or
    empty text, or one without licenses, gives none; repeated rows give their hits
    each, a null id is kept, other columns are not read. Templates are a parameter:
    a short list shipped with the function; coverage is over a template's whole text, so
    a license cut off after its first sentence is reported as that opening only. Of the
    built-in ones, BSD-2-Clause and BSD-3-Clause are told apart by the clause on names.
    A narrow step without shuffles.
    """
    scanner = Scanner(templates or TEMPLATES, min_coverage, None if templates else TELLING, max_span)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, 1):
                found = [(k, *hit) for k, t in enumerate(texts_of(block.column(1))) for hit in scanner.scan(t)]
                row, name, coverage, start, stop, runs = zip(*found) if found else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()),
                        pa.array(coverage, pa.float64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()),
                        pa.array([[{"start": s, "length": n} for s, n in r] for r in runs], run_type),
                    ],
                    names=["doc_id", "license", "coverage", "start", "stop", "runs"],
                )

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, license string, coverage double, start long, stop long, "
        "runs array<struct<start:bigint,length:bigint>>",
    )
