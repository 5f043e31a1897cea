"""License scans: MinHash bands over overlapping word windows, then exact containment.

A text is cut into blocks of a few words; neighbouring blocks form windows, so windows
overlap and each shingle is hashed once.  For every length class of templates a window
is at least twice as long as a template, and windows start often enough that any
occurrence lies within one.  Windows and templates that agree in a band are
candidates, and for those the share of the template's shingles that the window holds
is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.textbytes import column_bytes, field_names, mix, pieces

SHINGLE = 5
CONTAINMENT = 0.8
#: A window may miss a true match with this probability at most.
MISS = 1e-4

# Short notices of common licenses, as they are written in texts.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        f"the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program."
    )


#: What is scanned for: the short notices, and the full text or the usual header of common licenses.
NOTICES: Mapping[str, str] = {
    **TEMPLATES,
    "AGPL-3.0 header": _gnu("GNU Affero General Public License", "3"),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD-2-Clause text": _BSD_CONDITIONS + _BSD_WARRANTY,
    "BSD-3-Clause text": _BSD_CONDITIONS + _BSD_NAMES + _BSD_WARRANTY,
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0 header": _gnu("GNU General Public License", "2"),
    "GPL-3.0 header": _gnu("GNU General Public License", "3"),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "LGPL-3.0 header": _gnu("GNU Lesser General Public License", "3"),
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def bands_for(similarity: float, rows: int, miss: float = MISS) -> int:
    """Bands of ``rows`` hashes with which sets of this Jaccard similarity collide but with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def _folding() -> np.ndarray:
    """Bytes of words, ASCII letters in lower case; 0 for what separates words."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        if byte >= 128 or chr(byte).isalnum():
            table[byte] = ord(chr(byte).lower()) if byte < 128 else byte
    return table


_FOLD = _folding()
_RADIX = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of a stretch of bytes: where they start and end, and a hash of each."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @classmethod
    def read(cls, folded: np.ndarray) -> Words:
        inside = np.concatenate([[False], folded > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        powers = np.full(len(folded), _RADIX)
        if len(folded):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
        # Sums of powers from the word's end backwards do not depend on its place.
        sums = np.concatenate([[np.uint64(0)], np.cumsum(folded * powers[::-1], dtype=np.uint64)])
        own = sums[end] - sums[start]
        shift = powers[::-1][end - 1] if len(end) else np.zeros(0, np.uint64)
        return cls(start, end, mix(own * _inverse(shift) + (end - start).astype(np.uint64)))


def _inverse(odd: np.ndarray) -> np.ndarray:
    """Inverses of odd numbers modulo 2 ** 64, by Newton's steps."""
    out = odd.copy()
    for _ in range(5):
        out *= np.uint64(2) - odd * out
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash for the ``size`` words from each word on."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _RADIX + words[i : i + n]
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


class _Template(NamedTuple):
    name: str
    shingles: frozenset
    hashes: np.ndarray


def _word_tuples(folded: np.ndarray, words: Words, size: int) -> list[tuple[bytes, ...]]:
    raw = folded.tobytes()
    cut = [raw[s:e] for s, e in zip(words.start.tolist(), words.end.tolist())]
    return list(zip(*[cut[i:] for i in range(size)]))


def _template(name: str, text: str, size: int) -> _Template:
    folded = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    words = Words.read(folded)
    if len(words.start) < size:
        raise ValueError(f"template {name} has fewer than {size} words")
    return _Template(name, frozenset(_word_tuples(folded, words, size)), shingle_hashes(words.hash, size))


class _Class(NamedTuple):
    """Templates of similar length, and how many blocks of shingles their windows have."""

    templates: list[_Template]
    blocks: int


#: Shingles in a block.
BLOCK = 4


def _classes(templates: list[_Template]) -> list[_Class]:
    by_size: dict[int, list[_Template]] = {}
    for t in templates:
        by_size.setdefault((len(t.hashes) - 1).bit_length(), []).append(t)
    # Twice the longest template of the class lies within as many blocks wherever it starts.
    return [_Class(ts, -(-((2 << bits) - 1) // BLOCK) + 1) for bits, ts in sorted(by_size.items())]


def _least_similarity(classes: list[_Class], containment: float) -> float:
    """Smallest Jaccard similarity of a template and a window that has enough of it."""
    least = 1.0
    for c in classes:
        for t in c.templates:
            n = len(t.shingles)
            shared = math.ceil(containment * n - 1e-9)
            least = min(least, shared / (c.blocks * BLOCK + n - shared))
    return least


def _shortest(found: list[tuple]) -> tuple[int, int]:
    """First and last place of the first shortest stretch with all different shingles that were found."""
    wanted, held, a, best = len(set(found)), {}, 0, (0, len(found) - 1)
    for z, shingle in enumerate(found):
        held[shingle] = held.get(shingle, 0) + 1
        while held[found[a]] > 1:
            held[found[a]] -= 1
            a += 1
        if len(held) == wanted and z - a < best[1] - best[0]:
            best = a, z
    return best


class Scanner:
    """Finds templates in pieces of text; small enough to be sent to every task."""

    #: Bytes looked at together.
    PIECE = 512 << 10

    def __init__(self, templates: Mapping[str, str], containment: float, size: int, seed: int = 42):
        self.size, self.containment = size, containment
        read = [_template(name, text, size) for name, text in sorted(templates.items())]
        self.classes = _classes(read)
        # One hash per band: short templates share few shingles with a window.
        n = bands_for(_least_similarity(self.classes, containment), 1) if read else 0
        random = np.random.default_rng(seed)
        self.factors = random.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.shifts = random.integers(0, 1 << 32, n, dtype=np.uint32)
        self.tables = [
            [self._minima(t.hashes, np.array([0]))[:, 0] for t in c.templates] for c in self.classes
        ]
        # A part of a long text reaches as far into the next as any window may.
        self.overlap = 64 * BLOCK * max([c.blocks for c in self.classes], default=1) + 4096

    def _minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each band, the smallest hash of every block."""
        out = np.empty((len(self.factors), len(starts)), np.uint32)
        for band, (factor, shift) in enumerate(zip(self.factors, self.shifts)):
            spread = hashes * factor + shift
            # Low bits of a product are weak, so the smallest is taken over swapped halves.
            out[band] = np.minimum.reduceat(spread << np.uint32(16) | spread >> np.uint32(16), starts)
        return out

    @staticmethod
    def _windows(minima: np.ndarray, row: np.ndarray, blocks: int) -> np.ndarray:
        """Minima of ``blocks`` neighbouring blocks of a row from each block on, fewer at the row's end."""

        def joined(values: np.ndarray, more: np.ndarray, by: int) -> np.ndarray:
            out = values.copy()
            if by < len(row):
                same = row[by:] == row[:-by]
                out[:, :-by] = np.where(same, np.minimum(values[:, :-by], more[:, by:]), values[:, :-by])
            return out

        out, done = minima, 1
        while 2 * done <= blocks:
            out = joined(out, out, done)
            done *= 2
        return joined(out, out, blocks - done) if done < blocks else out

    def scan(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """``(row, template, containment, from byte, to byte)`` of each match; ``ends`` are the rows' last bytes."""
        folded = _FOLD[data]
        # A row's words end with it.
        gap = np.insert(folded, ends[:-1], 0)
        words = Words.read(gap)
        hashes = shingle_hashes(words.hash, self.size)
        if not len(hashes) or not self.classes:
            return []
        row = np.searchsorted(ends[:-1] + np.arange(len(ends) - 1), words.start, side="right")
        n = len(hashes)
        at = np.flatnonzero(row[:n] == row[self.size - 1 :])
        if not len(at):
            return []
        hashes, of = hashes[at], row[at]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        starts = np.flatnonzero(place % BLOCK == 0)
        block_row = of[starts]
        minima = self._minima(hashes, starts)
        found = []
        for c, tables in zip(self.classes, self.tables):
            windows = self._windows(minima, block_row, c.blocks)
            for template, table in zip(c.templates, tables):
                hit = np.flatnonzero((windows == table[:, None]).any(axis=0))
                for b in hit.tolist():
                    low = starts[b]
                    high = min(low + c.blocks * BLOCK, len(of))
                    inside = at[low:high][of[low:high] == block_row[b]]
                    held = [
                        (i, s) for i, s in zip(inside.tolist(), self._texts(gap, words, inside)) if s in template.shingles
                    ]
                    share = len({s for _, s in held}) / len(template.shingles)
                    if share >= self.containment:
                        r = int(block_row[b])
                        a, z = _shortest([s for _, s in held])
                        begin, end = int(words.start[held[a][0]]) - r, int(words.end[held[z][0] + self.size - 1]) - r
                        found.append((r, template.name, share, begin, end))
        return found

    def _texts(self, folded: np.ndarray, words: Words, inside: np.ndarray) -> list[tuple[bytes, ...]]:
        out = []
        for i in inside.tolist():
            spans = zip(words.start[i : i + self.size].tolist(), words.end[i : i + self.size].tolist())
            out.append(tuple(folded[s:e].tobytes() for s, e in spans))
        return out


_MATCH = "doc_id long, license string, containment double, first_byte long, end_byte long"


def _scan(scanner: Scanner) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            best: dict[tuple[int, str], tuple[float, int, int]] = {}
            for first, end, low, high in pieces(offsets, scanner.PIECE, scanner.overlap):
                ends = np.minimum(offsets[first + 1 : end + 1], high) - low
                for row, name, share, begin, stop in scanner.scan(data[low:high], ends):
                    place = max(low, int(offsets[first + row])) - int(offsets[first + row])
                    origin = max(0, int(offsets[first + row]) - low)
                    match = (share, place + begin - origin, place + stop - origin)
                    key = (first + row, name)
                    # The best match counts, and the first among equals.
                    if key not in best or (-match[0], match[1]) < (-best[key][0], best[key][1]):
                        best[key] = match
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array([k[0] for k in keys], pa.int64())),
                    pa.array([k[1] for k in keys], pa.string()),
                    *[pa.array([best[k][i] for k in keys], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))],
                ],
                names=field_names(_MATCH),
            )

    return scan


def scanned(
    docs: DataFrame,
    templates: Mapping[str, str] = NOTICES,
    containment: float = CONTAINMENT,
    size: int = SHINGLE,
) -> DataFrame:
    """A row for each document and template found in it, with the place of the best match in bytes.

    Words are runs of letters, digits and bytes beyond ASCII, in lower case.  A
    template is found if a window holds at least ``containment`` of its different
    shingles of ``size`` words.  Null and empty texts match nothing; rows that share
    an id are scanned each by itself.  Templates travel with the tasks, so they are
    meant to be few (thousands).
    """
    if not 0 < containment <= 1 or size < 1:
        raise ValueError("containment lies above 0 and up to 1, and a shingle has a word at least")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(_scan(Scanner(templates, containment, size)), _MATCH)
